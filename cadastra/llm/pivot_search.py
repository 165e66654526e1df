"""Exact top-k by inner product with pivot-table elimination.

Distances of every vector to ``PIVOTS`` pivots are computed once and stored beside its block. For a query q and a
candidate x, each pivot gives |d(q, p) - d(x, p)| <= d(q, x); the largest is the best lower bound of the distance, and
(|q|^2 + |x|^2 - bound^2) / 2 an upper bound of the inner product. The first ``FEW`` pivots are looked at for every
candidate, the others for those that remain. Candidates are evaluated in the order of their bound until it falls below
the k-th best score found: what is left cannot enter the result.

A query starts with the k-th best score of one block that all queries meet first, and carries it on from block to block
of its task. Query blocks and data blocks are dealt to a grid of groups of at most ``DATA_BLOCKS`` and ``QUERY_BLOCKS``
blocks by shuffles; nothing is broadcast.

Pivots are chosen farthest-first from a sample of ``SAMPLE`` vectors; any choice gives exact results. Vectors of a length
that the sample lacks have the origin as their one pivot.

Defined results: a row with the query's own id is the query's own; a repeated query id is answered once (by one of its
rows); repeated candidate rows each count; vectors of another length than the query's are no candidates; scores beyond a
long are held at its limits. Extra columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastra.llm.vectors import BLOCKS, blocks, unpack, usable
from cadastra.runtime import Workspace, ship_package

PIVOTS, FEW, SAMPLE = 64, 16, 2000
QUERY_BLOCK, BLOCK = 512, 4096
#: Bytes of a block's vectors, whatever their dimension.
BLOCK_BYTES = 2 << 20
DATA_BLOCKS, QUERY_BLOCKS = 32, 64
LONG = range(-(1 << 63), 1 << 63)


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest-first from the vector nearest to the mean."""
    chosen = [int(((sample - sample.mean(0)) ** 2).sum(1).argmin())]
    nearest = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.clip((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0, None))


def _upper(squares: np.ndarray, gaps: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Upper bounds of scores; what overflows a double bounds nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        upper = (squares - np.square(gaps)) / 2 + slack
    return np.where(np.isnan(upper), np.inf, upper)


def held(score: int) -> int:
    return min(max(score, LONG[0]), LONG[-1])


class Block:
    """Vectors of whole numbers with their ids, lengths and distances to the pivots."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, distances: np.ndarray) -> None:
        self.ids, self.data = ids, data
        self.few, self.distances = np.ascontiguousarray(distances[:, :FEW]), distances
        with np.errstate(over="ignore"):
            self.squares = (data * data).sum(1)
        self.largest = np.abs(data).max(1, initial=0)

    @staticmethod
    def of(row: pd.Series | dict) -> Block:
        ids, data = unpack(row["ids"], row["data"], row["dim"])
        return Block(ids, data, np.frombuffer(row["distances"], dtype=np.float64).reshape(len(ids), -1))


def block_top_k(asked: Block, held_by: Block, best: list[list[tuple[int, int]]], k: int, floors: np.ndarray | None = None) -> None:
    """Enters each query's best candidates of one block in ``best``: heaps of (score, -candidate), the worst first.

    ``floors``: a score for each query that its k best all reach.
    """
    for at, mine in enumerate(best):
        q, q2 = asked.data[at], asked.squares[at]
        floor = -np.inf if floors is None else floors[at]
        if len(mine) == k:
            floor = max(floor, mine[0][0])
        # a product of whole numbers that a double can't hold exactly is summed as such
        exact = np.maximum(held_by.largest, 1) * (max(asked.largest[at], 1) * held_by.data.shape[1]) < 2**53
        with np.errstate(over="ignore", invalid="ignore"):
            squares = q2 + held_by.squares
            # rounding of the distances must not hide a candidate
            slack = 1e-6 * squares + 1e-6
            gaps = np.abs(held_by.few - asked.few[at]).max(1)
        rest = np.flatnonzero((_upper(squares, gaps, slack) >= floor) & (held_by.ids != asked.ids[at]))
        with np.errstate(invalid="ignore"):
            gaps = np.abs(held_by.distances[rest] - asked.distances[at]).max(1, initial=0)
        upper = _upper(squares[rest], gaps, slack[rest])
        order = np.argsort(-upper, kind="stable")
        rest, upper = rest[order], upper[order]
        done, step = 0, 64
        while done < len(rest) and upper[done] >= floor:
            now = rest[done : done + step]
            if exact[now].all():
                scores = (held_by.data[now] @ q).astype(np.int64).tolist()
            else:
                scores = [int(row @ q) if sure else held(sum(int(a) * int(b) for a, b in zip(row, q, strict=True))) for row, sure in zip(held_by.data[now], exact[now].tolist(), strict=True)]
            for entry in zip(scores, (-held_by.ids[now]).tolist(), strict=True):
                if len(mine) < k:
                    heapq.heappush(mine, entry)
                elif entry > mine[0]:
                    heapq.heapreplace(mine, entry)
            if len(mine) == k:
                floor = max(floor, mine[0][0])
            done, step = done + step, 2 * step


def _task(k: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        candidates = [Block.of(row) for _, row in data.iterrows()] if len(asked) else []
        for _, row in asked.iterrows() if len(data) else ():
            queries = Block.of(row)
            best: list[list[tuple[int, int]]] = [[] for _ in queries.ids]
            floors = np.frombuffer(row["floors"], dtype=np.float64)
            for block in candidates:
                block_top_k(queries, block, best, k, floors)
            found += [(int(q), -minus, score) for q, mine in zip(queries.ids, best, strict=True) for score, minus in mine]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, workspace: Workspace) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors``: id, values (array<double> of whole numbers)."""
    spark = vectors.sparkSession
    ship_package(spark)
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("values").collect()
    by_length: dict[int, list] = {}
    for row in sample:
        by_length.setdefault(len(row["values"]), []).append(row["values"])
    pivots = {}
    for dim, rows in by_length.items():
        with np.errstate(over="ignore"):
            # a pivot whose square overflows bounds nothing
            near = [row for row in rows if np.isfinite(np.square(np.array(row)).sum() * 4)]
        if near:
            pivots[dim] = choose_pivots(np.array(near))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [unpack(ids, data, dim)[1] for ids, data, dim in zip(*(batch.column(c).to_pylist() for c in ("ids", "data", "dim")), strict=True)]
            stored = [_distances(data, pivots.get(data.shape[1], np.zeros((1, data.shape[1])))).tobytes() for data in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stored, pa.binary())], names=[*batch.schema.names, "distances"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = []
            for row in batch.to_pylist():
                queries = Block.of(row)
                best: list[list[tuple[int, int]]] = [[] for _ in queries.ids]
                block_top_k(queries, Block.of({"dim": row["dim"]} | {c: row[f"first_{c}"] for c in ("ids", "data", "distances")}), best, k)
                floors.append(np.array([mine[0][0] if len(mine) == k else -np.inf for mine in best], dtype=np.float64).tobytes())
            kept = [batch.column(c) for c in ("dim", "block", "ids", "data", "distances")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(floors, pa.binary())], names=["dim", "block", "ids", "data", "distances", "floors"])

    everything = workspace.save(blocks(vectors, BLOCK, BLOCK_BYTES).mapInArrow(measured, f"{BLOCKS}, distances binary"), "blocks")
    asked = workspace.save(blocks(vectors.where(is_query).dropDuplicates(["id"]), QUERY_BLOCK, BLOCK_BYTES).mapInArrow(measured, f"{BLOCKS}, distances binary"), "queries")
    # one block of each length
    seeds = everything.join(everything.groupBy("dim").agg(F.min("block").alias("block")), ["dim", "block"])
    seeds = seeds.select("dim", *(F.col(c).alias(f"first_{c}") for c in ("ids", "data", "distances")))
    met = asked.hint("merge").join(seeds, "dim").mapInArrow(first, "dim int, block string, ids binary, data binary, distances binary, floors binary")
    met = workspace.save(met, "met")
    n_data, n_asked = everything.count(), met.count()
    slots = max(1, -(-n_data // DATA_BLOCKS))
    # as many groups as keep every core busy
    q_slots = max(1, -(-n_asked // QUERY_BLOCKS), min(n_asked, -(-2 * spark.sparkContext.defaultParallelism // slots)))

    def dealt(table: DataFrame, mine: str, n: int, other: str, m: int) -> DataFrame:
        return table.withColumn(mine, F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    keys = ["dim", "slot", "q_slot"]
    left, right = dealt(everything, "slot", slots, "q_slot", q_slots), dealt(met, "q_slot", q_slots, "slot", slots)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_task(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), nonzero=False))
    # beyond 2^62 a double is a whole number already, and floor() to a long would overflow
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x * 256) < 2.0**62, F.floor(x * 256).cast("double")).otherwise(x * 256))
    vectors = table.select(F.col("vec_id").cast("long").alias("id"), whole.alias("values"))
    return top_k(vectors, F.col("id") % 50 == 0, 5, Workspace(spark, "pivot-search"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
