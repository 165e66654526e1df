"""Near-duplicate documents by HyperMinHash.

A document's set is that of its shingles of ``width`` words. Equal sets are one node. A node's registers are banded
(``BANDS`` bands of ``ROWS`` registers: a pair of similarity 0.8 shares no band with a probability of 1.3e-7), and

1. every node of a bucket is held against the bucket's most central one, whose buckets hold the most nodes: first by
   the collision-corrected estimate, then on the full sets; links make components;
2. buckets that still hold more than one component are gone through again, against a member drawn by a hash;
3. of what is left, every pair of nodes of a bucket that are in different components is compared exactly inside the
   join, by how both differ from the bucket's centre; only links come out. Nodes that differ too much from the centre
   for that are compared by their texts, unless distances to it (1 - Jaccard is a metric) or registers rule the pair out.

So no two nodes that share a band and belong together stay apart, and members of one group are not paired with one
another once they are known to be connected. The estimate only drops pairs 5 standard deviations below the threshold.

Defined results: a null text, or one without words, has an empty set and links with nothing; a text with fewer words
than ``width`` is one shingle; repeated rows share their component; rows of one id with different texts count as one
document; a null id never names a component but its own. Extra columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.graph import connected_components
from cadastra.llm.shingles import WORDS, HyperMinHash, common, digest, estimate, grouped, shingle_set
from cadastra.runtime import Workspace, ship_package

BANDS, ROWS = 40, 5
#: From this similarity on, a node is also known by how it differs from its bucket's centre.
TELL = 0.4
#: Ids of up to this many documents are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), registers (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = HyperMinHash(BANDS * ROWS)
        for batch in batches:
            sizes, first, second, registers = [], [], [], []
            for part in grouped([t or b"" for t in batch.column("text").to_pylist()]):
                sets = [shingle_set(w, width) for w in WORDS.of(part)]
                rows = iter(hasher.registers([s for s in sets if len(s)]))
                for s in sets:
                    a, b = digest(s)
                    sizes.append(len(s))
                    first.append(a)
                    second.append(b)
                    registers.append(next(rows).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(registers, pa.binary())], names=["doc_id", "n", "d1", "d2", "registers"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, registers binary")


def least_estimate(percent: int) -> float:
    """Five standard deviations below the threshold."""
    share = percent / 100
    return share - 5 * (share * (1 - share) / (BANDS * ROWS)) ** 0.5


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, estimate."""
    left = nodes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    right = nodes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1) for c in ("ra", "rb"))
            similar = estimate(ra, rb, batch.column("na").to_numpy().astype(float), batch.column("nb").to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(similar, pa.float64())], names=["a", "b", "estimate"])

    found = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long, estimate double")
    return found.groupBy("a", "b").agg(F.max("estimate").alias("estimate"))  # an id may have several texts


def _similarities(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """a, b, common, total (sizes of intersection and union) of the full sets; and, if they share ``TELL`` or more, what a lacks of b and has beside it.

    The b of many pairs is parsed once in a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] | None = None
        longs = pa.list_(pa.int64())
        for batch in batches:
            shared, total, lost, own = [], [], [], []
            for mine, theirs in zip(batch.column("ta"), batch.column("tb"), strict=True):
                raw = theirs.as_py()
                if last is None or last[0] != raw:
                    last = raw, shingle_set(WORDS.hashes(raw), width)
                a, b = shingle_set(WORDS.hashes(mine.as_py()), width), last[1]
                shared.append(common(a, b))
                total.append(len(a) + len(b) - shared[-1])
                near = shared[-1] >= TELL * total[-1] > 0
                lost.append(np.setdiff1d(b, a, assume_unique=True).view(np.int64) if near else None)
                own.append(np.setdiff1d(a, b, assume_unique=True).view(np.int64) if near else None)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(total, pa.int64()), pa.array(lost, longs), pa.array(own, longs)], names=["a", "b", "common", "total", "lost", "own"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, common long, total long, lost array<long>, own array<long>")


class _Run:
    def __init__(self, docs: DataFrame, workspace: Workspace, width: int, percent: int) -> None:
        self.docs, self.workspace, self.width, self.percent = docs, workspace, width, percent
        self.texts_seen = 0

    def pick(self, pairs: DataFrame, name: str) -> DataFrame:
        """Texts of the documents in ``pairs``."""
        ids = self.workspace.save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{name}-ids")
        small = ids.count() <= BROADCAST_IDS
        texts = self.docs.join(F.broadcast(ids) if small else ids, "doc_id").distinct()
        return self.workspace.save(texts, f"{name}-texts")

    def verify(self, pairs: DataFrame, nodes: DataFrame, name: str, least: float) -> tuple[DataFrame, DataFrame]:
        """Estimates of all pairs, and similarities of those whose estimate is ``least`` or more."""
        estimates = self.workspace.save(_estimated(pairs, nodes), f"{name}-estimates")
        likely = estimates.where(F.col("estimate") >= least).select("a", "b")
        found = self.workspace.save(_similarities(likely, self.pick(likely, name), self.width), f"{name}-found")
        self.workspace.drop(f"{name}-texts", f"{name}-ids")
        return estimates, found


def near_duplicates(docs: DataFrame, workspace: Workspace, width: int = 2, percent: int = 80) -> DataFrame:
    """``docs``: doc_id long, text. Returns doc_id, n_shingles, component_id, kept for every row."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows = workspace.save(_sketches(docs, width), "sketches")
    full = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    nodes = workspace.save(full, "nodes")
    run = _Run(docs.where("doc_id IS NOT NULL"), workspace, width, percent)
    linked = lambda found: found.where(F.col("common") * 100 >= F.col("total") * percent).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    banded = nodes.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("registers"), b * (2 * ROWS) + 1, F.lit(2 * ROWS))))).alias("band", "key"))
    banded = workspace.save(banded, "bands")
    crowded = banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high").select("key", "size")
    shared = workspace.save(banded.join(crowded, "key").select("key", "band", "id", "size"), "shared")
    workspace.drop("bands")
    central = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    weighed = shared.join(central, "id")
    leads = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("x")).select("key", (-F.col("x.minus")).alias("lead"))
    buckets = workspace.save(shared.join(leads, "key").select("key", "band", "id", "lead"), "buckets")
    workspace.drop("shared")

    guessed, first = run.verify(buckets.where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct(), nodes, "first", TELL - 5 * (0.25 / (BANDS * ROWS)) ** 0.5)
    links = linked(first)
    components = connected_components(links, workspace, "c1")

    def labelled(which: DataFrame) -> DataFrame:
        known = components.select(F.col("node").alias("id"), F.col("component").alias("c"))
        return which.join(known, "id", "left").withColumn("c", F.coalesce("c", "id"))

    def unsettled(which: DataFrame) -> DataFrame:
        """Rows of buckets that hold more than one component."""
        mixed_keys = which.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
        return which.join(mixed_keys, "key")

    # second round: another member of each bucket leads, drawn by a hash of both
    open_rows = workspace.save(unsettled(labelled(buckets)), "open1")
    drawn = open_rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "id").alias("draw"), F.col("id").alias("other"), F.col("c").alias("oc"))).alias("x")).select("key", "x.other", "x.oc")
    pairs = open_rows.join(drawn, "key").where("c <> oc").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    tested = first.select("a", "b").union(first.select("b", "a"))
    _, second = run.verify(pairs.join(tested, ["a", "b"], "left_anti"), nodes, "second", least_estimate(percent))
    links = workspace.save(links.union(linked(second)), "links2")
    components = connected_components(links, workspace, "c2")

    # the rest: pairs across components. A node is its bucket's centre b without what it lost, with what is its own, so
    # |x and y| = |b| - |lost x| - |lost y| + |lost by both| + |own of both|: exact, without the texts
    told = first.groupBy(F.col("a").alias("id"), F.col("b").alias("lead")).agg(F.count(F.lit(1)).alias("times"), F.first("lost").alias("lost"), F.first("own").alias("own"), F.first(F.col("common") + F.size("lost")).alias("nb"), F.min(1 - F.col("common") / F.col("total")).alias("d"))
    rough = guessed.select(F.col("a").alias("id"), F.col("b").alias("lead"), (1 - F.col("estimate")).alias("r"))
    away = rough.join(told, ["id", "lead"], "left").select("id", "lead", *(F.when(F.col("times") == 1, F.col(c)).alias(c) for c in ("lost", "own", "nb")), F.coalesce("d", "r").alias("d"), F.when(F.col("d").isNull(), 2.5 / (BANDS * ROWS) ** 0.5).otherwise(0.0).alias("doubt"))
    sizes = nodes.groupBy("id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    rest = unsettled(labelled(open_rows.drop("c"))).join(away, ["id", "lead"], "left").join(sizes, "id")
    centre, single, none = F.col("id") == F.col("lead"), F.col("texts") == 1, F.array().cast("array<long>")
    rest = rest.withColumns({c: F.when(single, F.when(centre, none).otherwise(F.col(c))) for c in ("lost", "own")} | {"nb": F.when(centre, F.col("n")).otherwise(F.col("nb")), "d": F.when(centre, 0.0).otherwise(F.col("d")), "doubt": F.coalesce("doubt", F.lit(0.0))})
    rest = workspace.save(rest.select("key", "id", "c", "n", "nb", "lost", "own", "d", "doubt"), "open2")
    x, y = (rest.select("key", *(F.col(c).alias(f"{c}_{s}") for c in rest.columns if c != "key")) for s in "xy")
    apart = (F.col("c_x") != F.col("c_y")) & (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent)
    enough = lambda both: both * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent
    size = lambda c: F.size(f"{c}_x") + F.size(f"{c}_y")
    most = F.col("nb_x") - F.greatest(F.size("lost_x"), F.size("lost_y")) + F.least(F.size("own_x"), F.size("own_y"))
    shared_size = F.col("nb_x") - size("lost") + F.size(F.array_intersect("lost_x", "lost_y")) + F.size(F.array_intersect("own_x", "own_y"))
    exact = x.where("lost_x IS NOT NULL").join(y.where("lost_y IS NOT NULL"), "key").where((F.col("id_x") < F.col("id_y")) & apart & enough(most) & enough(shared_size))
    # nodes that differ much from their centre, or whose id has several texts, are compared by their texts
    bound = F.coalesce(F.abs(F.col("d_x") - F.col("d_y")) - F.col("doubt_x") - F.col("doubt_y") <= (100 - percent) / 100 + 1e-9, F.lit(True))
    far = x.where("lost_x IS NULL").join(y, "key").where((F.col("id_x") != F.col("id_y")) & (F.col("lost_y").isNotNull() | (F.col("id_x") < F.col("id_y"))) & apart & bound)
    pairs = far.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()
    tested = first.select("a", "b").union(second.select("a", "b"))
    tested = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    _, third = run.verify(pairs.join(tested, ["a", "b"], "left_anti"), nodes, "third", least_estimate(percent))
    across = workspace.save(exact.select(F.col("id_x").alias("src"), F.col("id_y").alias("dst")).distinct(), "across")
    components = connected_components(links.union(linked(third)).union(across), workspace, "c3")

    named = nodes.select("d1", "d2", F.col("id").alias("node")).join(components, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("c"))
    out = rows.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, Workspace(spark, "minhash"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
h AS (SELECT doc_id, hash(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
links AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(l.y, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.x = d.doc_id
"""
