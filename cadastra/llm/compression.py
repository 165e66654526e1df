"""What the two compression classifiers share: windows, compressors, the training sample and the calibration.

A model is two zstandard dictionaries and a logistic curve over what the two compressed sizes tell. It is fitted on the
driver on a bounded sample of labelled rows (``SAMPLE`` of each class, in hash order of their ids, of texts of up to
``LONGEST`` bytes) and sent to the tasks, which score whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.runtime import ship_package

#: Labelled rows of each class, and bytes of the longest text, that a model is fitted on.
SAMPLE, LONGEST = 2000, 30_000
THRESHOLD = 0.7


def windows(text: bytes, size: int, pad: bytes = b"") -> list[bytes]:
    """The whole text in pieces of about ``size`` bytes, cut at spaces (a longer word isn't cut up to twice that size)."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            space = text.find(b" ", end, end + size)
            end = space if space >= 0 else end + size
        out.append(pad + text[at:end] + pad)
        at = end + 1 if text[end : end + 1] == b" " else end
    return out or [b""]


def raw_compressor(content: bytes, **how: int) -> zs.ZstdCompressor:
    """Content as it stands is the dictionary; frames carry nothing but the data."""
    kind = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    return zs.ZstdCompressor(dict_data=kind, compression_params=zs.ZstdCompressionParameters(format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, **how))


def trained_compressor(content: bytes, level: int) -> zs.ZstdCompressor:
    return zs.ZstdCompressor(level=level, dict_data=zs.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False, write_checksum=False)


@dataclass(frozen=True)
class Logistic:
    """P(label = 1) from features; fitted by Newton steps with a ridge."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        mean, scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[(x - mean) / scale, np.ones(len(x))]
        w = np.zeros(z.shape[1])
        keep = np.full(len(w), ridge)
        keep[-1] = 1e-3
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return Logistic(mean, scale, w)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        # features beyond what calibration saw are held at 6 standard deviations
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


FOLDS = 3


def cross_fitted(texts: dict[int, list[bytes]], build: Callable[[dict[int, list[bytes]]], Any], folds: int = FOLDS) -> tuple[Any, Logistic | None]:
    """The model built on all texts, and the curve fitted to features of texts that were left out in turn.

    ``build(texts)`` makes a model with ``features()``. Without ``folds`` texts of either class there is no curve.
    """
    if min(len(v) for v in texts.values()) < folds:
        return None, None
    x, y = [], []
    for fold in range(folds):
        of = build({k: [t for i, t in enumerate(v) if i % folds != fold] for k, v in texts.items()}).features()
        for value in (1, 0):
            left = texts[value][fold::folds]
            x += [of(t) for t in left]
            y += [float(value)] * len(left)
    return build(texts), Logistic.fit(np.array(x), np.array(y))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, sample: int = SAMPLE, longest: int = LONGEST) -> dict[int, list[bytes]]:
    """Distinct texts of each class, in hash order of the ids. ``allowed`` says which labelled ids may be learned from."""
    chosen = None
    for value in (0, 1):
        part = labels.where(allowed & (F.col(label) == value)).select("doc_id", F.lit(value).alias("value")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * sample short rows: bounded whatever the input
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.octet_length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    out: dict[int, dict[bytes, None]] = {0: {}, 1: {}}
    for row in sorted(rows.select("value", "doc_id", "text").collect(), key=lambda r: (zlib_order(r["doc_id"]), r["text"])):
        out[row["value"]][bytes(row["text"])] = None
    return {value: list(texts) for value, texts in out.items()}


def zlib_order(doc_id: int) -> int:
    import zlib

    return zlib.crc32(f"order {doc_id}".encode())


def score_table(docs: DataFrame, scorer: Callable[[], Callable[[bytes], float]], keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and ``score``; ``scorer()`` makes, in each task, the function of a text's bytes."""
    ship_package(docs.sparkSession)
    schema = docs.select(*keep).schema.add("score", "double")
    text = "__text"
    while text in keep:
        text += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            values = pa.array([score(t or b"") for t in batch.column(text).to_pylist()], pa.float64())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, values], names=[*keep, "score"])

    return docs.select(*keep, F.col("text").cast("binary").alias(text)).mapInArrow(run, schema)
