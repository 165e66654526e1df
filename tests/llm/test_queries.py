"""Registered queries against SQL, and the pipeline against its stages' rules."""

from __future__ import annotations

import pytest
from compare import database, same
from pyspark.sql import functions as F

import corpus_pipeline
from cadastra.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf_dir, name):
    assert same(QUERIES[name](spark, sf_dir), database(sf_dir), ORACLE_SQL[name]) > 0


def test_every_operator_is_registered():
    import __spark_entry__

    numbers = {int(n[2:].split("_")[0]) for n in QUERIES}
    assert numbers == set(range(1, 14)) and "pipeline" in __spark_entry__.queries()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
            continue
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
        if name == "toxicity":
            clean = before.join(labels.where("toxic = 0"), "doc_id")
            assert docs.join(clean.select("doc_id"), "doc_id").count() >= 0.95 * clean.count()
        if name in ("line_dedup", "passage_dedup"):
            assert docs.count() == before.count()
            assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0


def test_no_local_checkpoints():
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).resolve().parent
    for source in [root / "corpus_pipeline.py", *(root / "cadastra").rglob("*.py")]:
        assert "localCheckpoint" not in source.read_text()


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_pipeline_and_classifiers_on_odd_tables(spark, tmp_path, kind):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.limit(0) if kind == "empty" else docs.limit(30).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # a null id, and labels that contradict one another
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labels = labels.unionByName(labels.withColumns({"toxic": 1 - F.col("toxic"), "quality": 1 - F.col("quality")})).unionByName(labels.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    count = docs.count()
    assert QUERIES["op4_quality"](spark, str(tmp_path)).count() == QUERIES["op9_toxicity"](spark, str(tmp_path)).count() == count
    assert (corpus_pipeline.run(spark, str(tmp_path)).count() > 0) == (count > 0)
