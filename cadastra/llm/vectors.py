"""Vectors packed into blocks, shared by the two vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.runtime import ship_package

BLOCKS = "dim int, block string, size int, ids binary, data binary"


def usable(embedding: Column, nonzero: bool) -> Column:
    """Neither null nor empty, all components present and finite, and, if ``nonzero``, not all zero."""
    values = embedding.cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = F.coalesce(fine, F.lit(False)) & (F.coalesce(F.size(values), F.lit(0)) > 0)
    return out & F.coalesce(F.exists(values, lambda x: x != 0), F.lit(False)) if nonzero else out


def blocks(vectors: DataFrame, rows: int, most_bytes: int | None = None) -> DataFrame:
    """``vectors`` (id long, values array<double>) as blocks of up to ``rows`` vectors of one dimension, and up to ``most_bytes`` of more than one.

    ids are little-endian longs, data float64 in row order.
    """
    ship_package(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        part, count = TaskContext.get().partitionId(), 0

        def out(dim: int) -> pa.RecordBatch:
            nonlocal count
            ids, data = held.pop(dim)
            count += 1
            packed = [[dim], [f"{part}-{count}"], [len(ids)], [np.array(ids, dtype="<i8").tobytes()], [np.concatenate(data).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(packed, (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["dim", "block", "size", "ids", "data"])

        for batch in batches:
            ids = batch.column("id").to_pylist()
            values = batch.column("values")
            ends = values.offsets.to_numpy()
            flat = values.values.to_numpy(zero_copy_only=False)
            for i, number in enumerate(ids):
                row = flat[ends[i] : ends[i + 1]]
                mine = held.setdefault(len(row), ([], []))
                mine[0].append(number)
                mine[1].append(row)
                if len(mine[0]) >= (rows if most_bytes is None else min(rows, max(1, most_bytes // (8 * max(1, len(row)))))):
                    yield out(len(row))
        for dim in list(held):
            yield out(dim)

    return vectors.select("id", "values").mapInArrow(run, BLOCKS)


def unpack(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype="<i8"), np.frombuffer(data, dtype=np.float64).reshape(-1, dim)
