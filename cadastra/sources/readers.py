"""Readers and writers of the registry's files, all through Spark's own sources."""

from __future__ import annotations

import email
import re
from collections.abc import Iterator
from email import headerregistry, policy
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.runtime import ship_package

#: The canonical project document.
V1 = """
    metadata struct<schema_version: string, state_code: string, scraped_at: string>,
    project_details struct<registration_number: string, project_name: string, project_type: string, project_status: string, district: string, tehsil: string,
        project_address: string, launch_date: string, expected_completion_date: string>,
    promoter_details array<struct<name: string, organisation_type: string, email: string, phone: string, address: string>>,
    building_details array<struct<name: string, number_of_floors: int, number_of_units: int, carpet_area_sq_m: double>>,
    unit_types array<struct<name: string, carpet_area_sq_m: double, built_up_area_sq_m: double, price_in_inr: double>>,
    documents array<struct<name: string, document_type: string, url: string>>,
    quarterly_updates array<struct<quarter: string, year: int, status: string, completion_percent: double, remarks: string>>,
    bank_details array<struct<bank_name: string, ifsc: string, account_number: string>>,
    land_details array<struct<khasra: string, area_sq_m: double>>,
    raw_data struct<sections: map<string, map<string, string>>, unmapped_sections: map<string, map<string, string>>>,
    validation_messages array<string>"""
#: Tasks that read files, at least; small files come 32 to a task otherwise, and starting a task costs more than reading them.
READ_TASKS = 512
CHILDREN = ("promoter_details", "building_details", "unit_types", "documents", "quarterly_updates", "bank_details", "land_details")


def _files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of the files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.coalesce(max(READ_TASKS, 8 * spark.sparkContext.defaultParallelism))


def read_documents(spark: SparkSession, runs: str, pattern: str = "*.v1.json") -> DataFrame:
    """``runs``: a folder or glob of run folders, files by ``pattern``. One row per JSON document; run_id is its folder; a byte order mark is dropped.

    A document that isn't JSON has nulls and its text in ``broken``: one bad file doesn't stop a run.
    """
    files = _files(spark, runs, pattern)
    text = F.regexp_replace(F.decode(F.col("content"), "UTF-8"), "^\\uFEFF", "")
    rows = files.select(F.regexp_extract("path", r"/(run_[^/]*)/", 1).alias("run_id"), F.col("path"), text.alias("raw"))
    parsed = rows.withColumn("doc", F.from_json("raw", f"{V1}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    return parsed.select("run_id", "path", "doc.*").withColumn("broken", F.when(F.col("project_details").isNull(), F.coalesce("broken", F.lit("no project_details"))))


def shred(documents: DataFrame) -> dict[str, DataFrame]:
    """The project table and one table per child list, keyed by state and registration number."""
    key = [F.upper("metadata.state_code").alias("state_code"), F.col("project_details.registration_number").alias("reg_no")]
    fine = documents.where("project_details IS NOT NULL")
    day = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")).cast("date")
    out = {"projects": fine.select("run_id", *key, "project_details.*", "metadata.scraped_at").drop("registration_number").withColumns({"launch_date": day("launch_date"), "expected_completion_date": day("expected_completion_date")})}
    for child in CHILDREN:
        out[child] = fine.select(*key, F.posexplode(child).alias("position", "item")).select("state_code", "reg_no", "position", "item.*")
    return out


def read_html(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """page name, registration number of the file name, html."""
    pages = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return pages.select(name.alias("name"), F.regexp_extract(name, r"project_[^_]+_(.+)\.html$", 1).alias("reg_no"), F.col("value").alias("html"))


#: Parsed headers are kept: the library parses one anew each time it is asked for, most of the time that a page takes.
MHTML = policy.default.clone(header_factory=lru_cache(maxsize=256)(headerregistry.HeaderRegistry()))


def html_of_mhtml(raw: bytes) -> str | None:
    """First text/html part that isn't blank."""
    for part in email.message_from_bytes(raw, policy=MHTML).walk():
        if part.get_content_type() == "text/html":
            body = part.get_payload(decode=True) or b""
            try:
                text = body.decode(part.get_content_charset() or "utf-8")
            except (LookupError, UnicodeDecodeError):
                text = body.decode("utf-8", "replace")
            if text.strip():
                return text
    return None


def read_mhtml(spark: SparkSession, path: str) -> DataFrame:
    """path, html (null where a file holds none)."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([html_of_mhtml(b or b"") for b in batch.column("content").to_pylist()], pa.string())], names=["path", "html"])

    return _files(spark, path).select("path", "content").mapInArrow(run, "path string, html string")


def read_price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Prices of an import file; blank or unreadable numbers are null."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*(re.sub("^\\ufeff", "", c).strip() for c in rows.columns))
    money = [c for c in rows.columns if "price" in c]
    return rows.withColumns({c: F.expr(f"try_cast(nullif(trim(`{c}`), '') AS DECIMAL(14, 2))") for c in money})


def read_pdf_texts(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """path, is_pdf (by its first bytes), bytes, of every file under ``path``, sorted by name; text comes from elsewhere."""
    files = _files(spark, path)
    return files.select("path", (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"), F.col("length").alias("bytes"), (F.col("length") < least).alias("too_short")).orderBy(F.lower("path"))


def with_sidecars(pages: DataFrame, listings: DataFrame) -> DataFrame:
    """``pages`` (name, ...) with the fields of the listing file beside each, null where there is none.

    ``listings``: name of the listing file (``x.listing.json`` for ``x.html``) and its fields.
    """
    stem = lambda c, suffix: F.regexp_replace(c, suffix, "")
    left = pages.withColumn("__stem", stem("name", r"\.html$"))
    right = listings.withColumn("__stem", stem("name", r"\.listing\.json$")).drop("name")
    return left.join(right, "__stem", "left").drop("__stem")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV with a header; for reports, whose rows are few."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, nulls left out."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def replace_children(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``old`` whose project isn't loaded again, and all of ``new``: loading twice is loading once."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)
