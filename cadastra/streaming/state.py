"""Tables that change: slices overwritten in place, versions folded batch by batch, a cache read through, audited runs.

A slice is a partition directory, which Spark replaces when the write's job commits: a write that fails leaves the old slice,
and one that is repeated changes nothing. A version is a directory ``v=<batch>`` made from the versions before it, so that a
batch that runs again makes the same version again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadastra.runtime import one_of
from cadastra.streaming.files import latest_by_key

BUCKETS = 16


def bucket_of(*keys: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def overwrite_slices(df: DataFrame, path: str, by: str) -> None:
    """Replaces the slices that ``df`` has rows for; all others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(by).parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    # a version counts once its job has committed
    return sorted(int(name[2:]) for name in found if name.startswith("v=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")))


def before(spark: SparkSession, path: str, batch: int, schema: StructType) -> DataFrame:
    """The last version before ``batch``; empty where there is none."""
    known = [v for v in versions(spark, path) if v < batch]
    return spark.read.schema(schema).parquet(f"{path}/v={known[-1]}") if known else spark.createDataFrame([], schema)


def latest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return before(spark, path, 1 << 62, schema)


# children and statistics of projects


def reload_children(path: str, children: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The table at ``path`` with all rows of the projects in ``children`` replaced by these; only their slices are written.

    Loading twice is loading once. Columns besides the bucket must be the table's. Repeated rows stay; a null key is a project.
    """
    spark = children.sparkSession
    fresh = children.withColumn("bucket", bucket_of(key, buckets=buckets))
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        keys = fresh.select("bucket", F.col(key).alias("__key")).distinct()
        table = spark.read.schema(fresh.schema).parquet(path)
        touched = table.join(keys.select("bucket").distinct(), "bucket", "left_semi")
        others = touched.join(keys, (touched["bucket"] == keys["bucket"]) & touched[key].eqNullSafe(keys["__key"]), "left_anti")
        fresh = others.select(*fresh.columns).unionByName(fresh)
    overwrite_slices(fresh, path, "bucket")
    return spark.read.schema(fresh.schema).parquet(path).drop("bucket")


def recompute_stats(path: str, projects: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str, recompute: bool, buckets: int = BUCKETS) -> DataFrame:
    """The statistics at ``path`` with those of ``projects`` (a column ``key``) computed anew, or, without ``recompute``, only for projects that have none."""
    spark = projects.sparkSession
    wanted = projects.select(key).distinct()
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not recompute and root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        wanted = wanted.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    return reload_children(path, compute(wanted), key, buckets)


def record_verifications(history: DataFrame, arrivals: DataFrame, key: str, order: list[str], current: str = "is_current") -> DataFrame:
    """``history`` with ``arrivals`` entered and ``current`` set anew: of each key the last arrival by ``order`` is current, and whatever was current before is closed; keys without arrivals stay as they are.

    ``arrivals`` has the columns of ``history`` but for ``current``. Equal order values leave it to the other columns; of exact copies one is current.
    """
    ties = [c for c in arrivals.columns if c not in (key, *order)]
    new = one_of(history.columns, "newest")
    # copies as their number, so that one of them can be the current one
    distinct = arrivals.groupBy(*arrivals.columns).agg(F.count(F.lit(1)).alias(f"{new}_copies"))
    last = distinct.groupBy(F.col(key).alias(new)).agg(F.max(F.struct(*order, *ties)).alias(f"{new}_row"))
    entered = distinct.join(last, distinct[key].eqNullSafe(last[new])).withColumn(f"{new}_copy", F.explode(F.sequence(F.lit(1), F.col(f"{new}_copies"))))
    entered = entered.withColumn(current, (F.struct(*(F.col(c) for c in (*order, *ties))) == F.col(f"{new}_row")) & (F.col(f"{new}_copy") == 1))
    old = history.join(last.select(new, F.lit(True).alias(f"{new}_here")), history[key].eqNullSafe(last[new]), "left")
    old = old.withColumn(current, F.col(current) & F.col(f"{new}_here").isNull()).drop(new, f"{new}_here")
    return old.select(*history.columns).unionByName(entered.select(*history.columns))


# a cache that is read through


def read_through(requests: DataFrame, cache: DataFrame, provider: Callable[[DataFrame], DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """Answers to ``requests``, and what the provider was asked for: each ``key`` that the cache lacks, once.

    ``provider`` takes a column ``key`` of distinct values and gives rows of the cache's columns, none for what it doesn't find. Null
    keys are not asked for and have no answer. A request keeps its columns and gets those of the cache and ``hit``.
    """
    asked = requests.select(key).where(F.col(key).isNotNull()).distinct()
    fetched = provider(asked.join(cache.select(key), key, "left_anti")).select(*cache.columns)
    known = cache.withColumn("hit", F.lit(True)).unionByName(fetched.withColumn("hit", F.lit(False)))
    return requests.join(known, key, "left"), fetched


def fold_cache(path: str, provider: Callable[[DataFrame], DataFrame], key: str, schema: StructType, log: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: answers each batch from the versioned cache at ``path`` and stores what was missing; a replayed batch makes the same version and log again.

    ``log``: a folder that gets each batch's fetched keys.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cache = before(spark, path, number, schema)
        _, fetched = read_through(batch, cache, provider, key)
        if log is not None:
            # the log is what the version is made from: the provider is asked once
            fetched.write.mode("overwrite").parquet(f"{log}/v={number}")
            fetched = spark.read.schema(schema).parquet(f"{log}/v={number}")
        latest_by_key(cache.unionByName(fetched), [key], [c for c in schema.names if c != key]).write.mode("overwrite").parquet(f"{path}/v={number}")

    return fold


# states

# States of a project's coordinates.
NOT_GEOCODED, PENDING, SUCCESS, FAILED = "NOT_GEOCODED", "PENDING", "SUCCESS", "FAILED"


def geocode_pass(projects: DataFrame, geocoder: Callable[[DataFrame], DataFrame], limit: int, key: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """``projects`` after one pass, and a row of counts (processed, failed, not_geocoded, success).

    Up to ``limit`` projects without a state or NOT_GEOCODED are taken, smallest keys first, and are PENDING for the ``geocoder``,
    which gives key, lat, lon, source and failed for those it has an answer for: failed ones become FAILED, those without an answer
    are NOT_GEOCODED again, the others get their coordinates and SUCCESS. ``projects``: key, status, lat, lon, source and others.
    """
    open_ = F.coalesce(F.col("status") == NOT_GEOCODED, F.lit(True))
    taken = projects.where(open_).orderBy(key).limit(limit).select(*projects.columns).withColumn("status", F.lit(PENDING))
    found = geocoder(taken).select(F.col(key).alias("found_key"), F.col("lat").alias("found_lat"), F.col("lon").alias("found_lon"), F.col("source").alias("found_source"), "failed")
    state = F.when(F.col("failed"), FAILED).when(F.col("found_lat").isNull() | F.col("found_lon").isNull(), NOT_GEOCODED).otherwise(SUCCESS)
    done = taken.select(key).join(found, F.col(key) == F.col("found_key"), "left").select(F.col(key).alias("done_key"), state.alias("done"), "found_lat", "found_lon", "found_source")
    rows = projects.join(done, projects[key] == done["done_key"], "left")
    is_new = F.col("done") == SUCCESS
    put = {"status": F.coalesce("done", "status")} | {c: F.when(is_new, F.col(f"found_{c}")).otherwise(F.col(c)) for c in ("lat", "lon", "source")}
    counts = done.agg(F.count(F.lit(1)).alias("processed"), *(F.count_if(F.col("done") == s).alias(s.lower()) for s in (FAILED, NOT_GEOCODED, SUCCESS)))
    return rows.withColumns(put).select(*projects.columns), counts


# audits

AUDIT = "run_id string, status string, attempted long, succeeded long, failed long, error string, at timestamp"


def audited(spark: SparkSession, path: str, run_id: str, load: Callable[[], tuple[int, int, int]]) -> None:
    """Runs ``load`` (attempted, succeeded, failed) between an opening and a closing row of the audit at ``path``; a load that fails is recorded and raised.

    A run that is repeated writes its rows anew.
    """

    def enter(step: int, status: str, counts: tuple = (None, None, None), error: str | None = None) -> None:
        row = spark.createDataFrame([(run_id, status, *counts, error)], AUDIT.rsplit(",", 1)[0]).withColumn("at", F.current_timestamp())
        row.withColumns({"run": F.lit(run_id), "step": F.lit(step)}).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "step").parquet(path)

    enter(0, "running")
    try:
        counts = load()
    except Exception as error:
        enter(1, "failed", error=f"{type(error).__name__}: {error}"[:2000])
        raise
    enter(1, "completed", counts)


def audit_states(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each run: running where it has no closing one."""
    rows = spark.read.schema(f"{AUDIT}, run string, step int").parquet(path)
    last = rows.groupBy("run_id").agg(F.max_by(F.struct("status", "attempted", "succeeded", "failed", "error"), "step").alias("r"))
    return last.select("run_id", "r.*")
