"""Ordered, idempotent steps that bring a catalogue of views up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadastra.operators.registry import BY_NAME

Step = Callable[[SparkSession, dict[str, DataFrame]], None]


def view_step(view: str, operator: str) -> Step:
    """A step that (re)creates a temporary view of an operator over the given frames."""

    def run(spark: SparkSession, frames: dict[str, DataFrame]) -> None:
        BY_NAME[operator].apply(spark, **frames).createOrReplaceTempView(view)

    return run


STEPS: list[tuple[str, Step]] = [
    ("best_locations", view_step("best_locations", "win01_best_location")),
    ("latest_prices", view_step("latest_prices", "agg07_latest_price_envelope")),
    ("search_view", view_step("search_view", "jn01_read_model")),
]


def migrate(spark: SparkSession, frames: dict[str, DataFrame], steps: list[tuple[str, Step]] | None = None) -> list[str]:
    """Runs the steps in order and returns their names; running them again changes nothing."""
    done = []
    for name, step in steps if steps is not None else STEPS:
        step(spark, frames)
        done.append(name)
    return done
