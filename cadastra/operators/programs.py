"""Queries whose operator is more than one statement: parsers, streams, models. SQL is given where it can check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions.documents import leaves, linked_data, map_pages, title_case
from cadastra.functions.html import extract_pages
from cadastra.operators.models import impute, outliers
from cadastra.runtime import Workspace, shared_dir
from cadastra.sources.readers import V1, read_price_csv, write_csv, write_json
from cadastra.streaming.usage import first_seen, rate_limit_stream, rate_limits, sessions, usage_windows


def _usage(events: DataFrame) -> DataFrame:
    tier = F.when(F.col("user_id") % 3 == 0, "internal").when(F.col("user_id") % 3 == 1, "premium").otherwise("standard")
    code = F.when(F.col("event_id") % 9 == 0, 500).when(F.col("event_id") % 7 == 0, 404).otherwise(200)
    return events.select("event_id", F.col("user_id").alias("client"), F.col("event_type").alias("endpoint"), tier.alias("tier"), F.col("value").alias("ms"), code.alias("status_code"), F.col("ts").cast("timestamp").alias("ts"))


def _drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Everything a stream over what is there now puts out, written by the file sink."""
    spark = stream.sparkSession
    place = Workspace(spark, label)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", place.path("out")).option("checkpointLocation", place.path("state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(place.path("out"))


def stm01_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limits(_usage(spark.read.parquet(f"{sf_dir}/events.parquet"))).groupBy("client").agg(F.count(F.lit(1)).alias("requests"), F.count_if("allowed").alias("allowed"))


def stm01_rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        shared_dir(spark)
        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
        verdicts = _drained(rate_limit_stream(_usage(events)), "rate-limit")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return verdicts.groupBy("client").agg(F.count(F.lit(1)).alias("requests"), F.count_if("allowed").alias("allowed"))


def stm04_usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_windows(_usage(spark.read.parquet(f"{sf_dir}/events.parquet")))


def stm05_first_seen_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return _drained(first_seen(_usage(events), "event_id").select("event_id", "client"), "first-seen")


def stm_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(_usage(spark.read.parquet(f"{sf_dir}/events.parquet")))


def htm01_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def htm08_map_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")


def nst13_json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "props")


def nst16_linked_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    point = lambda f, n: F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey") * f % n / 1000)
    projects = orders.select(F.col("o_orderkey").alias("project_id"), F.concat(F.lit("Project "), "o_orderkey").alias("project_name"), F.concat(F.lit("RG"), "o_orderkey").alias("reg_no"), point(37, 7000).alias("lat"), point(91, 4000).alias("lon"), F.col("o_totalprice").alias("total_price"))
    return linked_data(projects)


def str02_title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", title_case(F.concat_ws("-", F.upper("p_name"), "p_type")).alias("title"))


def snk01_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written as CSV and read by the import's rules."""
    place = Workspace(spark, "csv").path("prices")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, "n/a").otherwise(F.col("p_retailprice").cast("decimal(14,2)").cast("string")).alias("min_price"))
    write_csv(rows, place, ["p_partkey", "min_price"])
    return read_price_csv(spark, place).select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("min_price").cast("double").alias("min_price"))


def snk04_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents written as JSON without nulls and read with their schema."""
    place = Workspace(spark, "json").path("documents")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    docs = orders.select(F.struct(F.concat(F.lit("RG"), "o_orderkey").alias("registration_number"), F.col("o_orderstatus").alias("project_status"), F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("launch_date")).alias("project_details"), F.struct(F.lit("cg").alias("state_code")).alias("metadata"))
    write_json(docs, place)
    back = spark.read.schema(V1).json(place)
    return back.select(F.upper("metadata.state_code").alias("state_code"), F.col("project_details.registration_number").alias("reg_no"), F.col("project_details.project_status").alias("status"), F.col("project_details.launch_date").alias("launch_date"))


def src09_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that reads the columns it names and nothing else."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")


def ml02_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 0 AND l_extendedprice > 0")
    rows = lines.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("area"), F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("rate"))
    return outliers(rows, ["area", "price", "rate"]).where("is_outlier").select("l_orderkey", "l_linenumber", F.round("anomaly_score", 6).alias("anomaly_score"))


def ml03_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = lines.select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity")).alias("units"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    return impute(rows, ["units"], ["price", "discount"]).select("l_orderkey", "l_linenumber", "units", "units_imputed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (stm01_rate_limit, stm01_rate_limit_stream, stm04_usage_windows, stm05_first_seen_stream, stm_sessions, htm01_extract, htm08_map_pages, nst13_json_leaves, nst16_linked_data, str02_title_case, snk01_csv_round_trip, snk04_json_round_trip, src09_table_scan, ml02_outliers, ml03_impute)}
_USAGE = "SELECT event_id, user_id AS client, event_type AS endpoint, value AS ms, CASE WHEN event_id % 9 = 0 THEN 500 WHEN event_id % 7 = 0 THEN 404 ELSE 200 END AS status_code, ts FROM events"
ORACLE_SQL = {
    "snk01_csv_round_trip": "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(CAST(p_retailprice AS DECIMAL(14, 2)) AS DOUBLE) END AS min_price FROM part",
    "snk04_json_round_trip": "SELECT 'CG' AS state_code, 'RG' || o_orderkey AS reg_no, o_orderstatus AS status, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS launch_date FROM orders",
    "src09_table_scan": "SELECT c_custkey, c_mktsegment FROM customer",
    "nst13_json_leaves": "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events",
    "str02_title_case": """
        SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(upper(p_name) || '-' || p_type), '([a-z]+|[^a-z]+)', 1), lambda w: upper(w[1]) || substr(w, 2)), '') AS title FROM part""",
    "stm04_usage_windows": f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, endpoint, count(*) AS requests, count(CASE WHEN status_code >= 400 THEN 1 END) AS errors, round(avg(ms), 4) AS avg_ms FROM ({_USAGE}) u GROUP BY 1, 2",
    "stm05_first_seen_stream": "SELECT DISTINCT event_id, user_id AS client FROM events",
    "stm_sessions": f"""
        WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY client ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM ({_USAGE}) u),
        numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY client ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM marked)
        SELECT client, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS requests FROM numbered GROUP BY client, no""",
}
