"""The corpus pipeline: toxicity filter, line dedup, near-dedup, passage dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents`` with
every row that they keep. ``run`` writes each stage's rows and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.compression import THRESHOLD
from cadastra.llm.line_dedup import dedup_lines
from cadastra.llm.minhash_dedup import near_duplicates
from cadastra.llm.packing import pack, pieces
from cadastra.llm.passage_dedup import WIDTH, find_matches, remove_passages
from cadastra.llm.toxicity import fit_toxicity, score_toxicity
from cadastra.runtime import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. The model learns from the labelled rows of ``documents``."""
    model = fit_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, COLUMNS).where(F.col("score") < THRESHOLD).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that four others or more repeat."""
    return _documents(dedup_lines(docs))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles): the one with the smallest id."""
    found = near_duplicates(docs, Workspace(spark, "pipeline-minhash"), width=WIDTH)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that a smaller id holds."""
    return _documents(remove_passages(docs, find_matches(docs.select("doc_id", "text"), Workspace(spark, "pipeline-passages"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences."""
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup), ("passage_dedup", passage_dedup), ("packing", packing)]
#: SQL can't express the first stage. The operators are tested by themselves, against brute force or held-out labels; of the stages, rows, columns and lengths.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = workspace.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
