"""Queries of files: written from the tables as they would arrive, one record a file, and read by the registry's readers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.runtime import Workspace, local_path
from cadastra.sources import readers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(rows: DataFrame, text: Column, path: str, folder: Column | None = None) -> str:
    """A file for each row, in ``folder`` under ``path`` if that is given: the text and a line feed, as Spark's text writer has it."""
    spark = rows.sparkSession
    values = rows.select(F.concat(F.lit("/"), folder).alias("folder") if folder is not None else F.lit("").alias("folder"), text.alias("value"))
    # tables of one row group would be written by one task
    values = values.repartition(2 * spark.sparkContext.defaultParallelism)
    here = local_path(spark, path)
    if here is None:
        folders = [r.folder for r in values.select("folder").distinct().collect()]
        for one in folders:
            values.where(F.col("folder") == one).select("value").write.option("maxRecordsPerFile", 1).text(f"{path}{one}")
        return path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # named by partition and row: a task that runs again writes the same files, each whole at once
        part, number, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for one, value in zip(batch.column("folder").to_pylist(), batch.column("value").to_pylist(), strict=True):
                place = f"{here}{one}/{part:05d}"
                if place not in made:
                    os.makedirs(place, exist_ok=True)
                    made.add(place)
                draft = f"{place}/.{number}-{uuid.uuid4().hex}"
                with open(draft, "wb") as out:
                    out.write((value or "").encode() + b"\n")
                os.replace(draft, f"{place}/part-{number:08d}")
                number += 1
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], names=["n"])

    values.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    os.makedirs(here, exist_ok=True)
    return path


def _documents(spark: SparkSession, sf_dir: str, label: str) -> str:
    """Suppliers as project documents in four runs; one in nine begins with a byte order mark, one in thirteen is broken."""
    root = Workspace(spark, label).path("runs")
    key = F.col("s_suppkey")
    details = F.struct(F.concat(F.lit("RG"), key.cast("string")).alias("registration_number"), F.col("s_name").alias("project_name"), F.lit("2024-03-01").alias("launch_date"), F.when(key % 2 == 0, "2024-13-40").alias("expected_completion_date"))
    promoters = F.transform(F.sequence(F.lit(1), (key % 3).cast("int") + 1), lambda i: F.struct(F.concat(F.lit("P"), i.cast("string")).alias("name")))
    whole = F.to_json(F.struct(F.struct(F.lit("cg").alias("state_code")).alias("metadata"), details.alias("project_details"), promoters.alias("promoter_details")))
    text = F.concat(F.when(key % 9 == 0, "﻿").otherwise(""), F.when(key % 13 == 0, F.lit("{broken")).otherwise(whole))
    return _files(_table(spark, sf_dir, "supplier"), text, root, F.concat(F.lit("run_"), (key % 4).cast("string"), F.lit("/scraped_json")))


def src01_run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of every run; one that is broken doesn't stop its run."""
    rows = readers.read_documents(spark, _documents(spark, sf_dir, "documents"), "part-*")
    return rows.select("run_id", F.col("project_details.registration_number").alias("reg_no"), F.upper("metadata.state_code").alias("state"), F.size("promoter_details").alias("promoters"), F.col("broken").isNotNull().alias("broken"))


def src02_shredded_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project table and the table of promoters of all runs."""
    # the files are read once, whatever reads the tables
    documents = Workspace(spark, "read").save(readers.read_documents(spark, _documents(spark, sf_dir, "shredded"), "part-*"), "documents")
    tables = readers.shred(documents)
    promoters = tables["promoter_details"].groupBy("state_code", "reg_no").agg(F.max_by("name", "position").alias("last_promoter"), F.count(F.lit(1)).alias("n"))
    return tables["projects"].join(promoters, ["state_code", "reg_no"]).select("run_id", "state_code", "reg_no", "project_name", "launch_date", "expected_completion_date", "last_promoter", "n")


def src03_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").where("html IS NOT NULL")
    path = _files(pages, F.concat(F.lit("<p>"), F.col("page_id").cast("string"), F.lit("</p>\n"), F.regexp_replace("html", "[\r\n]", " ")), Workspace(spark, "html").path("pages"))
    rows = readers.read_html(spark, path, "part-*")
    return rows.select(F.regexp_extract("html", "<p>([0-9]+)</p>", 1).try_cast("long").alias("page_id"), F.length("html").cast("long").alias("n_chars"))


def src04_mhtml_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' pages in MIME parts: a blank page first, a charset that doesn't exist, or no page at all."""
    key = F.col("s_suppkey")
    number = key.cast("string")
    page = lambda body, charset: F.concat(F.lit(f"--B\nContent-Type: text/html; charset={charset}\n\n"), body, F.lit("\n"))
    html = F.concat(F.lit("<html>"), number, F.lit(" é</html>"))
    parts = F.when(key % 4 == 0, F.concat(page(F.lit("  "), "utf-8"), page(html, "utf-8"))).when(key % 4 == 1, page(html, "no-such-set")).when(key % 4 == 2, F.concat(F.lit("--B\nContent-Type: text/plain\n\n"), number, F.lit("\n"))).otherwise(page(html, "utf-8"))
    text = F.concat(F.lit('MIME-Version: 1.0\nContent-Type: multipart/related; boundary="B"\nSubject: '), number, F.lit("\n\n"), parts, F.lit("--B--"))
    path = _files(_table(spark, sf_dir, "supplier"), text, Workspace(spark, "mhtml").path("pages"))
    return readers.read_mhtml(spark, path).select(F.regexp_extract(F.coalesce("html", F.lit("")), "<html>([0-9]+)", 1).try_cast("long").alias("k"), F.btrim("html", F.lit(" \r\n")).alias("html"))


def src06_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with what their listing files say, if there is one."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    name = lambda end: F.concat(F.lit("project_CG_"), F.col("c_custkey").cast("string"), F.lit(end)).alias("name")
    pages, listings = rows.select(name(".html"), "c_custkey"), rows.where("c_custkey % 3 = 0").select(name(".listing.json"), F.col("c_mktsegment").alias("segment"))
    return readers.with_sidecars(pages, listings)


def src07_pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which a third aren't what their name says, and some have next to no text."""
    key = F.col("s_suppkey")
    text = F.concat(F.when(key % 3 == 0, "<html>").otherwise("%PDF-1.7"), F.repeat(F.lit("x"), (key % 80).cast("int")))
    path = _files(_table(spark, sf_dir, "supplier"), text, Workspace(spark, "pdf").path("files"))
    return readers.read_pdf_texts(spark, path).groupBy("is_pdf", "too_short").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


QUERIES = {f.__name__: f for f in (src01_run_documents, src02_shredded_projects, src03_html_pages, src04_mhtml_pages, src06_sidecars, src07_pdf_files)}
ORACLE_SQL = {
    "src01_run_documents": """
        SELECT 'run_' || s_suppkey % 4 AS run_id, CASE WHEN s_suppkey % 13 <> 0 THEN 'RG' || s_suppkey END AS reg_no, CASE WHEN s_suppkey % 13 <> 0 THEN 'CG' END AS state,
               CAST(CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey % 3 + 1 END AS INTEGER) AS promoters, s_suppkey % 13 = 0 AS broken FROM supplier""",
    "src02_shredded_projects": """
        SELECT 'run_' || s_suppkey % 4 AS run_id, 'CG' AS state_code, 'RG' || s_suppkey AS reg_no, s_name AS project_name, DATE '2024-03-01' AS launch_date, CAST(NULL AS DATE) AS expected_completion_date,
               'P' || (s_suppkey % 3 + 1) AS last_promoter, CAST(s_suppkey % 3 + 1 AS BIGINT) AS n FROM supplier WHERE s_suppkey % 13 <> 0""",
    "src03_html_pages": "SELECT page_id, CAST(length('<p>' || page_id || '</p>' || chr(10)) + length(html) + 1 AS BIGINT) AS n_chars FROM pages WHERE html IS NOT NULL",
    "src04_mhtml_pages": "SELECT CASE WHEN s_suppkey % 4 <> 2 THEN s_suppkey END AS k, CASE WHEN s_suppkey % 4 <> 2 THEN '<html>' || s_suppkey || ' é</html>' END AS html FROM supplier",
    "src06_sidecars": "SELECT 'project_CG_' || c_custkey || '.html' AS name, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS segment FROM customer",
    "src07_pdf_files": """
        SELECT s_suppkey % 3 <> 0 AS is_pdf, size < 50 AS too_short, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 6 ELSE 8 END + s_suppkey % 80 + 1 AS size FROM supplier) s GROUP BY ALL""",
}
