"""Operators that are one declarative statement over named relations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cadastra.operators.selection import grouped_quantiles
from cadastra.plans.dialect import DUCK, SPARK
from cadastra.sources.domain import RELATIONS, TABLES

_NAME = re.compile(r"\{(\w+)\}")


def _needed(text: str, found: dict[str, str], dialect: object) -> None:
    """Relations that ``text`` names, innermost first."""
    for name in _NAME.findall(text):
        if name not in found and name in RELATIONS:
            body = RELATIONS[name](dialect)
            _needed(body, found, dialect)
            found[name] = body


@dataclass(frozen=True)
class Picked:
    """Exact quantiles by ``keys`` of the ``value`` in a statement's rows, a relation of their own for an operator: Spark takes them by distributed selection."""

    rows: Callable[[object], str]
    value: str
    keys: tuple[str, ...] = ()
    quantiles: dict[str, float] = field(default_factory=lambda: {"mid": 0.5})


@dataclass(frozen=True)
class Operator:
    """``statement(dialect)`` names its inputs in braces: relations of the domain model, tables, or one of ``picked``."""

    name: str
    ids: tuple[str, ...]
    statement: Callable[[object], str]
    picked: dict[str, Picked] = field(default_factory=dict)

    def apply(self, spark: SparkSession, **inputs: DataFrame) -> DataFrame:
        """The operator over DataFrames given by the names of its inputs."""
        over = lambda text, frames: spark.sql(text, **{n: frames[n] for n in dict.fromkeys(_NAME.findall(text))})
        return over(self.statement(SPARK), inputs | {n: grouped_quantiles(over(p.rows(SPARK), inputs), list(p.keys), p.value, p.quantiles) for n, p in self.picked.items()})

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The operator over the relations projected from the tables in ``sf_dir``."""
        table = lambda t: f"parquet.`{sf_dir}/{t}.parquet`"
        frames = {n: grouped_quantiles(spark.sql(_whole(p.rows(SPARK), {}, SPARK, table)), list(p.keys), p.value, p.quantiles) for n, p in self.picked.items()}
        return spark.sql(_whole(self.statement(SPARK), {}, SPARK, table, frames.keys()), **frames)

    def oracle(self) -> str:
        picks = {n: f"SELECT {''.join(f'{k}, ' for k in p.keys)}{', '.join(f'{DUCK.quantile(p.value, q)} AS {name}' for name, q in p.quantiles.items())} FROM ({p.rows(DUCK)}) picked_from {'GROUP BY ' + ', '.join(p.keys) if p.keys else ''}" for n, p in self.picked.items()}
        return _whole(self.statement(DUCK), picks, DUCK, lambda t: t)


def _whole(body: str, picks: dict[str, str], dialect: object, table: Callable[[str], str], kept: Iterable[str] = ()) -> str:
    """A statement with all the relations it names before it; ``kept`` names stay in braces."""
    found: dict[str, str] = {}
    for text in (*picks.values(), body):
        _needed(text, found, dialect)
    found |= picks
    named = lambda text: _NAME.sub(lambda m: m[0] if m[1] in kept else table(m[1]) if m[1] in TABLES and m[1] not in found else m[1], text)
    if not found:
        return named(body)
    parts = ", ".join(f"{name} AS ({named(text)})" for name, text in found.items())
    return f"WITH {parts} {named(body)}" if not body.lstrip().upper().startswith("WITH") else f"WITH {parts}, {named(body.lstrip()[4:])}"


def registry(operators: list[Operator]) -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    return {o.name: o.query for o in operators}, {o.name: o.oracle() for o in operators}
