"""Compression classifier for quality.

One zstandard dictionary is trained on good labelled text and one on bad. A text is compressed window by window with
either; the difference of the sizes, taken over the text's length and over the larger size, and the size itself become
P(good) by a logistic curve that was calibrated on labelled texts left out of the dictionaries in turn.

Defined results: null and empty texts get the score of the empty text; repeated rows score alike; labels, language,
source and id are no inputs. Where a class has fewer than three labelled texts, every score is 0.5. Extra columns pass through
``score_quality``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.compression import THRESHOLD, Logistic, cross_fitted, held_out, score_table, trained_compressor, training_texts, windows

DICTIONARY, WINDOW, LEVEL = 110_000, 256, 9
FOLDS, HELD_OUT = 4, 2


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    curve: Logistic | None

    def features(self) -> Callable[[bytes], np.ndarray]:
        good, bad = trained_compressor(self.good, LEVEL), trained_compressor(self.bad, LEVEL)

        def of(text: bytes) -> np.ndarray:
            parts = windows(text, WINDOW)
            a, b = sum(len(good.compress(w)) for w in parts), sum(len(bad.compress(w)) for w in parts)
            length = len(text) + len(parts)
            x = np.array([(b - a) / max(a, b), (b - a) / length, a / length, min(a, b) / length])
            return np.concatenate([x, x * x])

        return of

    def scorer(self) -> Callable[[bytes], float]:
        if self.curve is None:
            return lambda text: 0.5
        features, curve = self.features(), self.curve
        return lambda text: float(curve(features(text)))

    @staticmethod
    def build(texts: dict[int, list[bytes]]) -> QualityModel:
        made = []
        for value in (1, 0):
            samples = [w for t in texts[value] for w in windows(t, WINDOW)[:: max(1, len(t) // (20 * WINDOW))]]
            try:
                made.append(zs.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes())
            except zs.ZstdError:  # too few samples to train on: their text itself is the dictionary
                made.append(b"\n".join(samples)[-DICTIONARY:])
        return QualityModel(made[0], made[1], None)

    @staticmethod
    def fit(texts: dict[int, list[bytes]]) -> QualityModel:
        model, curve = cross_fitted(texts, QualityModel.build)
        return QualityModel(model.good, model.bad, curve) if model else QualityModel(b"", b"", None)


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    return score_table(docs, model.scorer, keep if keep is not None else [c for c in docs.columns if c != "score"])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = QualityModel.fit(training_texts(docs, labels, "quality", ~held_out(F.col("doc_id"), FOLDS, HELD_OUT)))
    scored = score_quality(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
