"""Compression-distance classifier for toxicity.

The ordinary dictionary holds the words of ordinary labelled text, the toxic one the same and, last, the words and stems
that toxic text has far more often. How often counts distinct neighbours, not occurrences, so that copies of one text don't
weigh. A text is compressed window by window with either; the bytes that the toxic dictionary saves, at most and in
all, become P(toxic) by a logistic curve calibrated on labelled texts left out of the dictionaries in turn.

Defined results: null and empty texts get the score of the empty text; repeated rows score alike; labels, language,
source and id are no inputs. Where a class has fewer than three labelled texts, every score is 0.5. Extra columns pass through;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.compression import THRESHOLD, Logistic, cross_fitted, held_out, raw_compressor, score_table, training_texts, windows

ORDINARY, TOXIC, WINDOW = 16_000, 8_000, 40
#: A toxic word has this share of toxic texts as distinct neighbourhoods, and this many times the ordinary rate; a stem, twice the share.
LEAST, LEAST_SHARE, RATIO, STEM_RATIO = 5, 1 / 40, 20, 50
HOW = {"min_match": 5, "strategy": zs.STRATEGY_BTOPT, "hash_log": 15, "chain_log": 15, "search_log": 5, "window_log": 16}
FOLDS, HELD_OUT = 3, 1
NOT_WORD = re.compile(rb"[^0-9a-z\x80-\xff]+")


def normal(text: bytes) -> bytes:
    return NOT_WORD.sub(b" ", text.decode("utf-8", "replace").lower().encode())


def neighbourhoods(texts: list[bytes]) -> dict[bytes, int]:
    """For each word, how many distinct pairs of neighbours it has."""
    seen: dict[bytes, set[int]] = defaultdict(set)
    for text in texts:
        words = normal(text).split()
        for before, word, after in zip([b"", *words], words, [*words[1:], b""], strict=False):
            seen[word].add(hash((before, after)))
    return {word: len(pairs) for word, pairs in seen.items()}


def stems(words: dict[bytes, int]) -> dict[bytes, int]:
    """Neighbourhoods of the words that begin with the same 4 to 7 letters, and go on."""
    out: dict[bytes, int] = defaultdict(int)
    for word, n in words.items():
        letters = word.decode()
        for size in range(4, min(8, len(letters))):
            out[letters[:size].encode()] += n
    return out


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    curve: Logistic | None

    def features(self) -> Callable[[bytes], np.ndarray]:
        plain, both = raw_compressor(self.ordinary, **HOW), raw_compressor(self.ordinary + self.toxic, **HOW)

        def of(text: bytes) -> np.ndarray:
            saved = np.array([len(plain.compress(w)) - len(both.compress(w)) for w in windows(normal(text).strip(), WINDOW, b" ")])
            beyond = np.clip(saved - 2, 0, None).sum()
            top = np.sort(saved)[-2:]
            return np.array([top[-1], top.sum(), beyond / len(saved) ** 0.5, np.log1p(beyond), np.log(len(saved))], dtype=float)

        return of

    def scorer(self) -> Callable[[bytes], float]:
        if self.curve is None:
            return lambda text: 0.5
        features, curve = self.features(), self.curve
        return lambda text: float(curve(features(text)))

    @staticmethod
    def build(texts: dict[int, list[bytes]]) -> ToxicityModel:
        toxic, plain = neighbourhoods(texts[1]), neighbourhoods(texts[0])
        toxic_all, plain_all = sum(toxic.values()) + 1, sum(plain.values()) + 1
        least = max(LEAST, round(len(texts[1]) * LEAST_SHARE))

        def marks(counts: dict[bytes, int], others: dict[bytes, int], count: int, ratio: float) -> list[tuple[int, bytes]]:
            return [(n, w) for w, n in counts.items() if n >= count and n / toxic_all > ratio * (others.get(w, 0) + 0.5) / plain_all]

        words = [(n, b" " + w + b" ") for n, w in marks(toxic, plain, least, RATIO)]
        begun = [(n, b" " + w) for n, w in marks(stems(toxic), stems(plain), 2 * least, STEM_RATIO)]
        common = sorted((n, w) for w, n in plain.items())[-6000:]
        ordinary = b" " + b" ".join(w for _, w in common) + b" "
        return ToxicityModel(ordinary[-ORDINARY:], b"".join(w for _, w in sorted(words + begun))[-TOXIC:], None)

    @staticmethod
    def fit(texts: dict[int, list[bytes]]) -> ToxicityModel:
        model, curve = cross_fitted(texts, ToxicityModel.build)
        return ToxicityModel(model.ordinary, model.toxic, curve) if model else ToxicityModel(b"", b"", None)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    return score_table(docs, model.scorer, keep if keep is not None else [c for c in docs.columns if c != "score"])


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return ToxicityModel.fit(training_texts(docs, labels, "toxic", ~held_out(F.col("doc_id"), FOLDS, HELD_OUT)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
