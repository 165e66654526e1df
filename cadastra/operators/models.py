"""Outliers by isolation forest and imputation by chained regressions.

The forest's trees, of 256 rows each, are grown from a sample drawn by the rows' keys and sent to the tasks; every row is
scored, and the threshold is that of all scores. The regressions come from sums and cross-products over all rows, one
set for each pattern of missing values, and are applied as linear expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.runtime import Workspace, ship_package

TREES, SUBSAMPLE, SEED = 100, 256, 42
SAMPLE = 50_000


def _depth(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, left and right child, depth of a leaf with its correction."""

    def __init__(self, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(x))
        self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)], rng) for _ in range(trees)]

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        most = int(np.ceil(np.log2(max(2, len(x)))))
        nodes: list[list[float]] = []

        def node(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0, 0, 0, depth + _depth(len(rows))])
            spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(x.shape[1])
            if depth < most and len(rows) > 1 and spread.max() > 0:
                feature = int(rng.choice(np.flatnonzero(spread > 0)))
                cut = rng.uniform(rows[:, feature].min(), rows[:, feature].max())
                low = rows[:, feature] < cut
                nodes[at][:4] = [feature, cut, node(rows[low], depth + 1), node(rows[~low], depth + 1)]
            return at

        node(x, 0)
        return tuple(np.array(c) for c in zip(*nodes, strict=True))

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; high where few random cuts isolate a row."""
        total = np.zeros(len(x))
        for feature, cut, left, right, depth in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                f = feature[at[rows]].astype(np.int64)
                at[rows] = np.where(x[rows, f] < cut[at[rows]], left[at[rows]], right[at[rows]]).astype(np.int64)
            total += depth[at]
        return 2 ** (-total / len(self.trees) / max(_depth(self.size), 1e-9))


def order_statistic(df: DataFrame, column: str, rank: int, parts: int = 4096) -> float:
    """The value of ``column`` (no nulls) with ``rank`` values before it in order; counts of ever narrower ranges, exact."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high:
        inside = df.where(F.col(column).between(low, high))
        part = F.floor((F.col(column) - F.lit(low)) / F.lit((high - low) / parts))
        for row in sorted(inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()):
            if rank < row["n"]:
                low, high = row["low"], row["high"]
                break
            rank -= row["n"]
    return float(low)


def outliers(df: DataFrame, features: list[str], share: float = 0.01, sample: int = SAMPLE) -> DataFrame:
    """``df`` without rows that lack a feature, with ``anomaly_score`` and ``is_outlier`` (the highest ``share`` of all scores).

    The trees' rows are drawn by a hash of the other columns, which tell rows of equal features apart.
    """
    ship_package(df.sparkSession)
    whole = df.dropna(subset=features)
    keys = [c for c in df.columns if c not in features]
    taken = whole.orderBy(F.xxhash64(*keys) if keys else F.rand(SEED)).select(*features).limit(sample).toPandas().to_numpy(dtype=float)
    if not len(taken):
        return whole.withColumns({"anomaly_score": F.lit(None).cast("double"), "is_outlier": F.lit(False)})
    forest = Forest(taken)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series(forest.score(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    scored = Workspace(df.sparkSession, "outliers").save(whole.withColumn("anomaly_score", score(*features)), "scored")
    # the rows at or above the quantile are those from the next score on
    edge = order_statistic(scored, "anomaly_score", int(np.ceil((1 - share) * (scored.count() - 1))))
    return scored.withColumn("is_outlier", F.col("anomaly_score") >= edge)


def impute(df: DataFrame, targets: list[str], helpers: list[str], rounds: int = 10, ridge: float = 1e-3) -> DataFrame:
    """``df`` with missing ``targets`` filled by chained ridge regressions on the other columns; filled values are never negative.

    A missing helper counts as its mean.
    """
    columns = [*targets, *helpers]
    x = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]
    seen = df.agg(F.count(F.lit(1)), *(f(c) for c in x for f in (F.avg, F.stddev_pop))).first()
    if not seen[0]:
        return df
    means = np.array([0.0 if m is None else m for m in seen[1::2]])
    spread = np.array([1.0 if s is None else s + 1e-9 for s in seen[2::2]])
    z = [F.coalesce((c - float(means[i])) / float(spread[i]), F.lit(0.0)) for i, c in enumerate(x)]
    places = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    pattern = F.array(*(c.isNull() for c in x)).alias("gap")
    patterns = []
    for row in df.groupBy(pattern).agg(F.count(F.lit(1)), *(F.sum(z[i] * z[j]) for i, j in places)).collect():
        products = np.zeros((len(columns), len(columns)))
        for (i, j), total in zip(places, row[2:], strict=True):
            products[i, j] = products[j, i] = total
        # what stands in each column, as a linear map of the values that are there
        patterns.append((row[0], row[1], products, np.eye(len(columns))))
    weights = np.zeros((len(targets), len(columns)))
    for _ in range(rounds):
        for t in range(len(targets)):
            others = [i for i in range(len(columns)) if i != t]
            known = [p for p in patterns if not p[0][t]]
            count = sum(p[1] for p in known)
            gram = sum((m @ products @ m.T for _, _, products, m in known), np.zeros((len(columns), len(columns))))
            w = np.linalg.solve(gram[np.ix_(others, others)] + (ridge * count + 1e-9) * np.eye(len(others)), gram[others, t]) if known else np.zeros(len(others))
            weights[t, others] = w
            for gap, _, _, m in patterns:
                if gap[t]:
                    m[t] = w @ m[others]
    scaled = {c: F.coalesce((F.col(c).cast("double") - float(means[i])) / float(spread[i]), F.lit(0.0)) for i, c in enumerate(columns)}
    new = {}
    for t, target in enumerate(targets):
        guess = sum((scaled[c] * float(weights[t, i]) for i, c in enumerate(columns) if i != t), F.lit(0.0)) * float(spread[t]) + float(means[t])
        new[target] = F.coalesce(F.col(target).cast("double"), F.greatest(F.lit(0.0), F.rint(guess)))
    return df.withColumns(new | {f"{t}_imputed": F.col(t).isNull() for t in targets})
