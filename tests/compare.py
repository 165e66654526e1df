"""Spark rows against DuckDB's, whatever their order."""

from __future__ import annotations

import decimal
import math

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def plain(value: object) -> str:
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def same(frame: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> int:
    cursor = connection.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    order = sorted(columns)
    expected = sorted(tuple(plain(dict(zip(columns, row, strict=True))[c]) for c in order) for row in cursor.fetchall())
    got = sorted(tuple(plain(row[c]) for c in order) for row in frame.collect())
    assert got == expected
    return len(got)
