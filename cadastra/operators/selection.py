"""Exact quantiles of few, huge groups.

``percentile`` keeps a group's distinct values in one task. Here values are counted, dealt in ranges of (group, value), and the
ranges' sums say which range holds a rank; only there a running sum is taken. A task works on one range of one group, and
the tables of sums have a row for each range a group reaches into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.runtime import Workspace


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """``keys`` and a column for each of ``qs``: the exact quantile, between two values in proportion to their distance.

    Null values don't count; a null key is a group; groups without values have no row; without keys all rows are one group.
    """
    workspace = Workspace(df.sparkSession, "quantiles")
    group = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.select(group.alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    counts = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    # saved: the number of a range is then a value like any other
    ranged = workspace.save(counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "counts")
    parts = ranged.groupBy("g", "part").agg(F.sum("n").alias("m"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    wanted = parts.groupBy("g").agg(F.sum("m").alias("total")).select("g", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), ((F.col("total") - 1) * F.lit(q)).alias("place")) for name, q in qs.items()))).alias("w"))
    wanted = wanted.select("g", "w.name", "w.place", F.explode(F.array_distinct(F.array(F.floor("w.place"), F.ceil("w.place")))).alias("rank"))
    at = workspace.save(wanted.join(parts, "g").where("before <= rank AND rank < before + m").select("g", "part", "name", "place", "rank", "before"), "ranks")
    running = Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = ranged.join(at.select("g", "part").distinct(), ["g", "part"], "left_semi").withColumn("up_to", F.sum("n").over(running))
    found = held.join(at, ["g", "part"]).where("before + up_to - n <= rank AND rank < before + up_to")
    both = found.groupBy("g", "name", "place").agg(F.min_by("v", "rank").alias("low"), F.max_by("v", "rank").alias("high"))
    both = both.withColumn("value", F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place")))
    out = both.groupBy("g").agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in qs))
    return out.select(*(F.col(f"g.{k}").alias(k) for k in keys), *qs)
