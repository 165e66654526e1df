"""Queries of tables that change: statistics recomputed in slices, children loaded again, verifications, a cache, passes over states, audits.

Each runs the change on tables in the shared folder and returns the table as it then is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.runtime import Workspace
from cadastra.streaming import state


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dml07_recomputed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of two thirds of the orders; a third recomputed by a new rule, twice; then all that have none."""
    path = Workspace(spark, "stats").path("stats")
    lines = _table(spark, sf_dir, "lineitem")
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"))

    def stats(rule: int):
        def compute(keys: DataFrame) -> DataFrame:
            rows = lines.join(keys, F.col("l_orderkey") == F.col("project_id")).groupBy("project_id", F.col("l_returnflag").alias("kind"))
            return rows.agg((F.count(F.lit(1)) * rule).alias("n")).withColumn("rule", F.lit(rule))

        return compute

    rest = F.col("project_id") % 3
    state.recompute_stats(path, orders.where(rest != 0), stats(1), "project_id", True)
    for _ in range(2):
        state.recompute_stats(path, orders.where(rest == 1), stats(2), "project_id", True)
    return state.recompute_stats(path, orders, stats(3), "project_id", False)


def snk05_reloaded_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all orders; those of every fifth order are loaded again, fewer and with new values, twice."""
    path = Workspace(spark, "children").path("units")
    units = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("unit_no"), F.lit(0).alias("version"))
    state.reload_children(path, units, "project_id")
    again = units.where("project_id % 5 = 0 AND unit_no < 3").withColumn("version", F.lit(1))
    state.reload_children(path, again, "project_id")
    return state.reload_children(path, again, "project_id")


def dml04_verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as verifications of their orders: the older ones are the history, the newer ones arrive."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("verification"), F.col("l_returnflag").alias("status"), F.col("l_shipdate").cast("date").alias("day"))
    # no day comes before all days
    is_new = F.coalesce(F.col("day") >= F.lit("1996-01-01").cast("date"), F.lit(False))
    old, new = rows.where(~is_new), rows.where(is_new)
    empty = spark.createDataFrame([], "project_id long, verification int, status string, day date, is_current boolean")
    columns = [F.col(f.name).cast(f.dataType) for f in empty.schema.fields[:-1]]
    history = Workspace(spark, "verifications").save(state.record_verifications(empty, old.select(*columns), "project_id", ["day", "verification"]), "history")
    return state.record_verifications(history, new.select(*columns), "project_id", ["day", "verification"])


CACHE = "address string, lat double, lon double, batch int"


def src10_geocode_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' addresses in four batches, of which the third is replayed: the cache, and how often the provider was asked for each address."""
    workspace = Workspace(spark, "geocodes")
    path, log = workspace.path("cache"), workspace.path("log")
    schema = spark.createDataFrame([], CACHE).schema
    people = _table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(", ", F.upper("c_mktsegment"), (F.col("c_custkey") % 40).cast("string")).alias("address"))
    for number in (0, 1, 2, 2, 3):

        def provider(asked: DataFrame, number: int = number) -> DataFrame:
            place = F.split_part("address", F.lit(", "), F.lit(2)).cast("int")
            return asked.where(place % 9 != 4).select("address", (20 + place / 10).alias("lat"), (80 + F.length("address") / 10).alias("lon"), F.lit(number).alias("batch"))

        state.fold_cache(path, provider, "address", schema, log)(people.where((F.col("c_custkey") / 40).cast("int") % 4 == number), number)
    calls = spark.read.schema(schema).parquet(*(f"{log}/v={v}" for v in state.versions(spark, log))).groupBy("address").agg(F.count(F.lit(1)).alias("calls"))
    return state.latest(spark, path, schema).join(calls, "address")


def dml08_geocode_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes over the suppliers, a third of them each; one in seven fails, one in five is not found."""
    workspace = Workspace(spark, "passes")
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project_id"), F.when(F.col("s_suppkey") % 4 == 0, state.NOT_GEOCODED).when(F.col("s_suppkey") % 11 == 0, state.SUCCESS).alias("status"), *(F.lit(None).cast(t).alias(c) for c, t in (("lat", "double"), ("lon", "double"), ("source", "string"))))

    def geocoder(taken: DataFrame) -> DataFrame:
        fails = F.col("project_id") % 7 == 0
        found = taken.where("project_id % 5 <> 0 OR project_id % 7 = 0")
        return found.select("project_id", F.when(~fails, 20 + F.col("project_id") % 10 / 10).alias("lat"), F.when(~fails, F.lit(81.5)).alias("lon"), F.lit("map").alias("source"), fails.alias("failed"))

    third = -(-rows.count() // 3)
    for number in range(3):
        after, _ = state.geocode_pass(rows, geocoder, third)
        rows = workspace.save(after, f"pass{number}")
    return rows


def dml10_audited_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four loads of a quarter of the orders each; one meets a broken row, one never closes, one is repeated."""
    workspace = Workspace(spark, "audits")
    path = workspace.path("audit")
    orders = _table(spark, sf_dir, "orders")

    def load(number: int, broken: bool):
        def run() -> tuple[int, int, int]:
            part = orders.where(F.col("o_orderkey") % 4 == number).select("o_orderkey", "o_orderstatus")
            if broken:
                part = part.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "O", F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("o_orderstatus")))
            done = workspace.save(part, f"run{number}")
            row = done.agg(F.count(F.lit(1)), F.count_if(F.col("o_orderstatus") != "P"), F.count_if(F.col("o_orderstatus") == "P")).first()
            return tuple(int(x) for x in row)

        return run

    for number in (0, 1, 1, 2):
        try:
            state.audited(spark, path, f"run_{number}", load(number, number == 2))
        except Exception:  # the load's own failure; the audit has it
            if number != 2:
                raise
    spark.createDataFrame([("run_3", "running")], "run_id string, status string").withColumns({"run": F.lit("run_3"), "step": F.lit(0)}).write.mode("append").partitionBy("run", "step").parquet(path)
    states = state.audit_states(spark, path)
    return states.select("run_id", "status", "attempted", "succeeded", "failed", F.contains("error", F.lit("broken row")).alias("broken"))


QUERIES = {f.__name__: f for f in (dml07_recomputed_stats, snk05_reloaded_children, dml04_verifications, src10_geocode_cache, dml08_geocode_passes, dml10_audited_runs)}
ORACLE_SQL = {
    "dml07_recomputed_stats": """
        SELECT l_orderkey AS project_id, l_returnflag AS kind, count(*) * CASE l_orderkey % 3 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS n, CAST(CASE l_orderkey % 3 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INTEGER) AS rule
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, l_returnflag""",
    "snk05_reloaded_children": """
        SELECT l_orderkey AS project_id, l_linenumber AS unit_no, CAST(CASE WHEN l_orderkey % 5 = 0 AND r.k IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS version
        FROM lineitem LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber < 3) r ON r.k = l_orderkey WHERE r.k IS NULL OR l_linenumber < 3""",
    "dml04_verifications": """
        SELECT l_orderkey AS project_id, CAST(l_linenumber AS INTEGER) AS verification, l_returnflag AS status, CAST(l_shipdate AS DATE) AS day,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_shipdate AS DATE) DESC, l_linenumber DESC, l_returnflag DESC) = 1 AS is_current FROM lineitem""",
    "src10_geocode_cache": """
        WITH a AS (SELECT upper(c_mktsegment) || ', ' || c_custkey % 40 AS address, c_custkey % 40 AS place, CAST((c_custkey // 40) % 4 AS INTEGER) AS batch FROM customer)
        SELECT address, 20 + any_value(place) / 10.0e0 AS lat, 80 + length(address) / 10.0e0 AS lon, min(batch) AS batch, CAST(1 AS BIGINT) AS calls FROM a WHERE place % 9 <> 4 GROUP BY address""",
    "dml08_geocode_passes": """
        WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 <> 0 AND s_suppkey % 11 = 0 AS done, s_suppkey % 7 = 0 AS fails, s_suppkey % 5 = 0 AND s_suppkey % 7 <> 0 AS lost, (SELECT (count(*) + 2) // 3 FROM supplier) AS third FROM supplier),
        p1 AS (SELECT *, row_number() OVER (PARTITION BY done ORDER BY k) AS r FROM s),
        q1 AS (SELECT *, NOT done AND r <= third AS t1 FROM p1),
        q2 AS (SELECT *, NOT done AND NOT (t1 AND NOT lost) AS open2 FROM q1),
        p2 AS (SELECT *, row_number() OVER (PARTITION BY open2 ORDER BY k) AS r2 FROM q2),
        q3 AS (SELECT *, open2 AND r2 <= third AS t2 FROM p2),
        q4 AS (SELECT *, open2 AND NOT (t2 AND NOT lost) AS open3 FROM q3),
        p3 AS (SELECT *, row_number() OVER (PARTITION BY open3 ORDER BY k) AS r3 FROM q4),
        e AS (SELECT *, t1 OR t2 OR (open3 AND r3 <= third) AS seen FROM p3)
        SELECT k AS project_id, CASE WHEN done THEN 'SUCCESS' WHEN NOT seen THEN CASE WHEN k % 4 = 0 THEN 'NOT_GEOCODED' END WHEN fails THEN 'FAILED' WHEN lost THEN 'NOT_GEOCODED' ELSE 'SUCCESS' END AS status,
               CASE WHEN seen AND NOT done AND NOT fails AND NOT lost THEN 20 + k % 10 / 10.0e0 END AS lat, CASE WHEN seen AND NOT done AND NOT fails AND NOT lost THEN 81.5e0 END AS lon, CASE WHEN seen AND NOT done AND NOT fails AND NOT lost THEN 'map' END AS source FROM e""",
    "dml10_audited_runs": """
        SELECT 'run_' || r AS run_id, CASE r WHEN 2 THEN 'failed' WHEN 3 THEN 'running' ELSE 'completed' END AS status, CASE WHEN r < 2 THEN count(*) END AS attempted, CASE WHEN r < 2 THEN count(*) FILTER (WHERE o_orderstatus <> 'P') END AS succeeded,
               CASE WHEN r < 2 THEN count(*) FILTER (WHERE o_orderstatus = 'P') END AS failed, CASE WHEN r = 2 THEN true END AS broken FROM (SELECT o_orderkey % 4 AS r, o_orderstatus FROM orders) o GROUP BY r""",
}
