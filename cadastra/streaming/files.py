"""Arrival of run directories: new JSON documents are upserted by their natural key, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by ``order`` (descending, nulls last)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order)))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Old and new rows, the new one winning for a key that both have. Applied twice it changes nothing more."""
    both = new.withColumn("__age", F.lit(1))
    if old is not None:
        both = old.withColumn("__age", F.lit(0)).unionByName(both)
    return latest_by_key(both, keys, ["__age", *order]).drop("__age")


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Reads what has arrived in ``source`` since the last call and folds it into the versioned table at ``target``.

    Every batch writes a new version ``v=<batch id>`` and nothing in place, so a batch that is run again is harmless.
    """

    def fold(batch: DataFrame, number: int) -> None:
        root = spark._jvm.org.apache.hadoop.fs.Path(target)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        done = sorted(int(s.getPath().getName()[2:]) for s in files.listStatus(root)) if files.exists(root) else []
        before = [v for v in done if v < number]
        old = spark.read.parquet(f"{target}/v={before[-1]}") if before else None
        upsert(old, batch, keys, order).write.mode("overwrite").parquet(f"{target}/v={number}")

    stream = spark.readStream.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(source)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
