"""Line deduplication over levelled sorted runs of line hashes (DataFrame functions only).

A *run* is a table of line hashes, sorted within buckets of their hash; all runs have the same number of buckets, so that
joining and merging them moves no row of an earlier run. Every batch of documents is merge-anti-joined with the runs:
keys that no run holds are its fresh keys, with the number of documents that hold them and the largest of their ids; for
the others it keeps what it adds to these, apart. Both halves are the batch's run at level 0. When a level holds
``FANOUT`` runs they are merged into one run of the next level, so that a store of n batches has O(log n) runs.

A key is fresh in exactly one run. So the repeated lines come from the fresh halves as they stand, with the sums of
the other halves joined to them: only lines that came again in a later batch are ever grouped anew.

Keys are 128 bits (two differently seeded 64-bit hashes), so that distinct lines don't meet at 10^12 lines.

Defined results: a null or empty text is one empty line and is never shortened; lines under ``min_chars`` code points
are kept always; a repeated row of the same document id counts that document once, and the kept copy of a line stays in
every row of the largest id. A null id counts as one document and, being the least, never keeps a line that a numbered document
holds. Extra columns pass through ``dedup_lines``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.runtime import Workspace, one_of

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_CHARS, MIN_DOCS = 40, 5
#: Runs of one level that are merged into one of the next, and batches that one corpus is fed in.
FANOUT, BATCHES = 3, 4


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


class LineRuns:
    """The levelled store. ``levels[i]`` names the runs of level i, oldest first."""

    def __init__(self, spark: SparkSession, workspace: Workspace | None = None) -> None:
        self.spark = spark
        self.workspace = workspace or Workspace(spark, "line-runs")
        # that of Spark's own exchanges: a batch is dealt once, by the exchange of its aggregation
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self._made = 0

    def _write(self, run: DataFrame, level: int) -> str:
        name = f"level{level}_run{self._made}"
        self._made += 1
        self.workspace.save_buckets(run, name, self.buckets, ["h1", "h2"])
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _union(self, names: list[str]) -> DataFrame:
        out = self.workspace.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.workspace.table(name))
        return out

    def add(self, keys: DataFrame) -> None:
        """``keys``: h1, h2, doc_id, one row for each document and distinct key of a new batch."""
        batch = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if names := self.runs():
            known = self._union(names).where("fresh").select("h1", "h2")
            batch = self.workspace.save_buckets(batch, f"batch{self._made}", self.buckets, ["h1", "h2"])
            fresh = batch.join(known.hint("merge"), ["h1", "h2"], "left_anti").withColumn("fresh", F.lit(True))
            again = batch.join(known.hint("merge"), ["h1", "h2"], "left_semi").withColumn("fresh", F.lit(False))
            batch = fresh.unionByName(again)
        else:
            batch = batch.withColumn("fresh", F.lit(True))
        self.levels[0].append(self._write(batch, 0))
        level = 0
        while len(self.levels[level]) >= FANOUT:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        names = self.levels[level]
        if level + 1 == len(self.levels):
            self.levels.append([])
        merged = self._union(names).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"), F.max("fresh").alias("fresh"))
        self.levels[level + 1].append(self._write(merged, level + 1))
        self.levels[level] = []
        self.workspace.drop(*names)

    def repeated(self, min_docs: int) -> DataFrame:
        """h1, h2, last_doc of every key that at least ``min_docs`` documents hold."""
        rows = self._union(self.runs())
        more = rows.where("NOT fresh").groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_more"), F.max("last_doc").alias("last_more"))
        totals = rows.where("fresh").join(more, ["h1", "h2"], "left")
        enough = totals.where(F.col("n_docs") + F.coalesce("n_more", F.lit(0)) >= min_docs)
        # greatest() passes over nulls
        return enough.select("h1", "h2", F.greatest("last_doc", "last_more").alias("last_doc"))


def _long_lines(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """rid, doc_id, pos, h1, h2 of the lines that can be dropped."""
    lines = docs.select("rid", "doc_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))
    # a line can't have more code points than bytes
    keyed = lines.where(F.octet_length("line") >= min_chars).withColumn("k", line_key(F.col("line"))).where(F.char_length("k") >= min_chars)
    return keyed.select("rid", "doc_id", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), F.col("k")).alias("h2"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with ``text`` shortened and n_lines, n_dropped added (columns so named before are replaced)."""
    spark = docs.sparkSession
    workspace = Workspace(spark, "line-dedup")
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # one number for each row: rows that repeat a document id stay apart
    rid = F.xxhash64(F.col(doc_id).cast("string"), F.col(text))
    slim = docs.select(rid.alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = workspace.save(_long_lines(slim, "text", min_chars), "lines")
    store = LineRuns(spark, workspace)
    for number in range(batches):
        mine = found.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == number)
        store.add(mine.select("h1", "h2", "doc_id").distinct())
    # saved, so that Spark knows its size: it is broadcast if small; else both sides are plain shuffles, and AQE splits a hot
    # key, which one side holds once
    doomed = workspace.save(store.repeated(min_docs), "doomed")
    gone = found.join(doomed, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    lines, drop, key, owner = (one_of(docs.columns, c) for c in ("lines", "drops", "rid", "owner"))
    drops = gone.groupBy(F.col("rid").alias(key), F.col("doc_id").alias(owner)).agg(F.collect_set("pos").alias(drop))
    whole = docs.select(*others, rid.alias(key), F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias(lines))
    joined = whole.join(drops, (whole[key] == drops[key]) & whole[doc_id].eqNullSafe(drops[owner]), "left").drop(drops[key])
    kept = F.transform(F.array_except(F.transform(lines, lambda _, i: i), F.coalesce(F.col(drop), F.array().cast("array<int>"))), lambda p: F.get(F.col(lines), p))
    out = joined.withColumn(text, F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    return out.select(*others, F.size(lines).cast("long").alias("n_lines"), F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long").alias("n_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split),
doomed AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT s.doc_id, s.pos, s.line, d.k IS NOT NULL AND s.doc_id <> d.last_doc AS gone
  FROM keyed s LEFT JOIN doomed d ON s.k = d.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
