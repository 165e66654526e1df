"""Collocations from count tries that grow level by level.

A node of the trie is a phrase within a language, its path the language and the words. Each pass over the texts grows one level:
a shard (a bounded number of words of one task) counts its phrases of that length and hands them on as a sorted run; the runs
are cut into ranges of paths, each range's runs are merged in order, and equal paths summed. A phrase is counted only where
its first and its last words, one fewer, may be frequent themselves: a bit filter of bounded size, made from the level
before, says so. It errs on one side only, so that no frequent phrase is lost at any size; a filter that has become
full only saves less.

A walk over the merged trie in path order meets every node after its ancestors, whose counts are the left parts. The few nodes whose
ancestors ended the range before are completed by a join of at most ``depth`` rows a range. Suffix links (the path without its
first word) give the right parts, level by level, since a right part's right parts are those of the phrase, too.

Scores are exact: counts up to 10^15 multiply as decimals of 38 digits.

Defined results: a null text is empty, a null language ``und``; repeated rows count each on their own; phrases never reach over
a piece's end nor over two texts; extra columns are not read; an empty table gives an empty result; ties are settled by
the order that ``collocations`` states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastra.runtime import Workspace, ship_package

MIN_COUNT, LONGEST, TOP, COVER = 10, 3, 2000, 50
#: Signs that end a piece (fixed); a tab parts words as a space does.
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(ENDS + b"\t", b"." * len(ENDS) + b" ")
#: Words, and bytes of them, that one shard counts together; bytes of a text that are cut into words together.
SHARD_WORDS, SHARD_BYTES, BLOCK = 2_000_000, 64 << 20, 4 << 20
#: A filter has 16 bits a path at least, up to 2^22 blocks of 64 bits (32 MB).
MOST_BLOCKS = 1 << 22
#: Parts that a language's phrases are ranked in before they are ranked together.
PARTS = 64
SEP = "\0"
RUN = "path string, n long"


def escaped(word: bytes) -> bytes:
    """Keeps the order, and the separator out of words."""
    return word.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") if b"\1" in word or b"\0" in word else word


def plain(phrase: Column) -> Column:
    return F.replace(F.replace(F.replace(phrase, F.lit(SEP), F.lit(" ")), F.lit("\1\1"), F.lit(SEP)), F.lit("\1\2"), F.lit("\1"))


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _digests(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _mask(h: np.ndarray) -> np.ndarray:
    one, low = np.uint64(1), np.uint64(63)
    return one << (h & low) | one << (h >> np.uint64(6) & low) | one << (h >> np.uint64(12) & low)


class Filter:
    """Paths of one level that may be frequent; ``bits`` is a power of two of 64-bit blocks."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.shift = np.uint64(65 - len(bits).bit_length())

    def has(self, h: np.ndarray) -> np.ndarray:
        mask = _mask(h)
        return self.bits[(h >> self.shift).astype(np.int64)] & mask == mask


def level_filter(level: DataFrame, depth: int) -> Filter:
    """A filter of the paths in ``level``, whose blocks are put together on the executors; the driver gets 32 MB at most."""
    blocks = 1 << min(MOST_BLOCKS.bit_length() - 1, max(10, (level.count() // 4).bit_length()))
    shift = np.uint64(65 - blocks.bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [p.split(b"\0") for p in batch.column("path").cast(pa.binary()).to_pylist()]
            h = _digests([p[0] for p in parts])
            for k in range(1, depth + 1):
                h = _mixed(h, _digests([p[k] for p in parts]))
            yield pa.record_batch([pa.array((h >> shift).astype(np.int32)), pa.array(_mask(h).view(np.int64))], names=["block", "mask"])

    found = level.select("path").mapInArrow(run, "block int, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(blocks, dtype=np.uint64)
    bits[found.column("block").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return Filter(bits)


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Shard:
    """One level's phrases in some texts of one language."""

    def __init__(self, lang: bytes, depth: int, known: Filter | None) -> None:
        self.lang, self.depth, self.known = escaped(lang), depth, known
        self.clear()

    def clear(self, carried: list[bytes] = []) -> None:  # noqa: B006
        self.ids, self.parts, self.words, self.bytes = Ids({b".": 0}), [], 0, 0
        # words that only begin phrases: those that end among them are counted already
        self.context = len(carried)
        if carried:
            self._put(carried)

    def _put(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words)))
        self.words += len(words)

    def add(self, text: bytes) -> Iterator[pa.RecordBatch]:
        text = text.lower().translate(TABLE)  # of bytes, lower() changes A-Z only
        start = 0
        while start < len(text):
            stop = len(text)
            if stop - start > BLOCK:
                stop = text.rfind(b" ", start, start + BLOCK) + 1 or text.find(b" ", start + BLOCK) + 1 or stop
            self._put(text[start:stop].replace(b".", b" . ").split())
            self.bytes += stop - start
            start = stop
            if self.words >= SHARD_WORDS or self.bytes >= SHARD_BYTES:
                yield from self.flush()
        self.parts.append(np.zeros(1, dtype=np.int64))

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The sorted run of what was added; the last words stay as context."""
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, dtype=np.int64)
        names = list(self.ids)
        carried = [names[i] for i in ids[len(ids) - self.depth + 1 :].tolist()] if self.depth > 1 else []
        order = [0, *sorted(range(1, len(names)), key=names.__getitem__)]
        rank = np.empty(len(names), dtype=np.int64)
        rank[order] = np.arange(len(names))
        ids, names = rank[ids], [escaped(names[i]) for i in order]
        yield from self._count(ids, names)
        self.clear(carried)

    def _count(self, ids: np.ndarray, names: list[bytes]) -> Iterator[pa.RecordBatch]:
        depth, last = self.depth, len(ids) - self.depth + 1
        if depth == 1:
            counts = np.bincount(ids, minlength=len(names))[1:]
            if total := int(counts.sum()):
                yield pa.record_batch([pa.array([self.lang], pa.binary()).view(pa.string()), pa.array([total], pa.int64())], names=["path", "n"])
            seen = np.flatnonzero(counts)
            yield from self._rows([seen + 1], counts[seen], names)
            return
        if last <= 0:
            return
        fits = np.arange(last) + depth > self.context
        for k in range(depth):
            fits &= ids[k : last + k] != 0
        if self.known is not None:
            digests = _digests(names)
            h = np.full(last + 1, _digests([self.lang])[0])
            for k in range(depth - 1):
                h = _mixed(h, digests[ids[k : last + 1 + k]])
            may = self.known.has(h)
            fits &= may[:-1] & may[1:]
        at = np.flatnonzero(fits)
        node = ids[at]
        for k in range(1, depth):
            code = node * len(names) + ids[at + k]
            if k < depth - 1:
                _, node = np.unique(code, return_inverse=True)
            else:
                _, first, counts = np.unique(code, return_index=True, return_counts=True)
        yield from self._rows([ids[at[first] + k] for k in range(depth)], counts, names)

    def _rows(self, levels: list[np.ndarray], counts: np.ndarray, names: list[bytes]) -> Iterator[pa.RecordBatch]:
        words = pa.array(names, pa.binary())
        for start in range(0, len(counts), 100_000):
            part = slice(start, start + 100_000)
            path = pc.binary_join_element_wise(pa.scalar(self.lang, pa.binary()), *(words.take(pa.array(level[part])) for level in levels), pa.scalar(b"\0", pa.binary()))
            yield pa.record_batch([path.view(pa.string()), pa.array(counts[part].astype(np.int64))], names=["path", "n"])


def level_runs(docs: DataFrame, depth: int, known: Broadcast | None) -> DataFrame:
    """``path``, ``n``: each shard's phrases of ``depth`` words, sorted; at depth 1 the roots (a language and its words) too."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[bytes, Shard] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").cast(pa.binary()).to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if lang not in shards:
                    shards[lang] = Shard(lang, depth, known and known.value)
                yield from shards[lang].add(text)
            # many languages share the bound
            while sum(s.words for s in shards.values()) > 2 * SHARD_WORDS or sum(s.bytes for s in shards.values()) > 2 * SHARD_BYTES:
                yield from shards.pop(max(shards, key=lambda s: shards[s].words)).flush()
        for shard in shards.values():
            yield from shard.flush()

    return docs.mapInArrow(run, RUN)


def trie_levels(docs: DataFrame, workspace: Workspace, depth: int = LONGEST, min_count: int = MIN_COUNT) -> list[DataFrame]:
    """``path``, ``n`` of the roots and, for each length up to ``depth``, of the phrases with ``min_count`` occurrences."""
    spark = docs.sparkSession
    known, levels = None, []
    for k in range(1, depth + 1):
        runs = workspace.save(level_runs(docs, k, known), f"runs{k}")
        merged = runs.repartitionByRange("path").groupBy("path").agg(F.sum("n").alias("n"))
        root = F.instr("path", SEP) == 0
        level = workspace.save(merged.where((F.col("n") >= min_count) | root), f"level{k}")
        if k == 1:
            levels.append(level.where(root))
            level = level.where(~root)
        levels.append(level)
        workspace.drop(f"runs{k}")
        known = spark.sparkContext.broadcast(level_filter(level, k)) if k < depth else None
    return levels


def walked(levels: list[DataFrame], workspace: Workspace) -> DataFrame:
    """``path``, ``depth``, ``n``, ``lefts``: the counts of a node's ancestors, root first."""
    depths = len(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.full(depths, -1, dtype=np.int64)  # the last count at each depth
        for batch in batches:
            depth = pc.count_substring(batch.column("path"), SEP).to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy()
            lefts = np.empty((len(n), depths), dtype=np.int64)
            for k in range(depths):
                at = np.maximum.accumulate(np.where(depth == k, np.arange(len(n)), -1))
                lefts[:, k] = np.where(at >= 0, n[at], state[k])
            if len(n):
                state = lefts[-1].copy()
            flat = lefts[np.arange(depths) < depth[:, None]]
            ends = np.concatenate([[0], np.cumsum(depth)]).astype(np.int32)
            yield pa.record_batch([batch.column("path"), pa.array(depth.astype(np.int32)), batch.column("n"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["path", "depth", "n", "lefts"])

    trie = levels[0]
    for level in levels[1:]:
        trie = trie.unionByName(level)
    walk = workspace.save(trie.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(run, "path string, depth int, n long, lefts array<long>"), "walk")
    # ancestors that ended the range before: one path a range and depth
    missing = walk.where(F.exists("lefts", lambda x: x < 0)).select(F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("k"), "path", "lefts")
    missing = missing.where(F.get("lefts", F.col("k")) < 0).select("k", F.expr(r"substring_index(path, '\0', k + 1)").alias("path")).distinct()
    found = workspace.save(missing.join(trie, "path").select("k", F.col("path").alias("above"), F.col("n").alias("n_above")), "ancestors")
    for k in range(depths - 1):
        here = found.where(F.col("k") == k).select("above", "n_above")
        lost = (F.col("depth") > k) & (F.get("lefts", F.lit(k)) < 0)
        key = F.when(lost, F.substring_index("path", SEP, k + 1))
        walk = walk.withColumn("key", key).join(F.broadcast(here), F.col("key") == F.col("above"), "left")
        put = F.transform("lefts", lambda x, i: F.when((i == k) & (x < 0), F.col("n_above")).otherwise(x))
        walk = walk.withColumn("lefts", F.when(lost, put).otherwise(F.col("lefts"))).drop("key", "above", "n_above")
    return walk


def suffix(path: Column) -> Column:
    """The path without its first word."""
    return F.concat(F.substring_index(path, SEP, 1), F.substring(path, F.length(F.substring_index(path, SEP, 2)) + 1, F.length(path)))


def candidates(docs: DataFrame, depth: int = LONGEST, min_count: int = MIN_COUNT, cover: int = COVER, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases that no longer one covers: a longer candidate with ``cover`` percent of the occurrences drops the phrases within it."""
    workspace = Workspace(docs.sparkSession, "collocations")
    slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    levels = trie_levels(slim, workspace, depth, min_count)
    walk = workspace.save(walked(levels, workspace), "walked")
    # right parts by suffix links: the longest first
    below = walk.where("depth = 1").select("path", "n", F.array().cast("array<bigint>").alias("rights"))
    found = []
    for k in range(2, depth + 1):
        link = below.select(F.col("path").alias("link"), F.col("n").alias("n_link"), F.col("rights").alias("rest"))
        here = walk.where(F.col("depth") == k).withColumn("link", suffix(F.col("path"))).join(link, "link")
        here = workspace.save(here.select("path", "n", "lefts", F.concat(F.array("n_link"), "rest").alias("rights")), f"rights{k}")
        found.append(here)
        below = here
    out: DataFrame | None = None
    for k, here in enumerate(found, 2):
        if k < depth:
            longer = found[k - 1]
            inside = longer.select(F.substring_index("path", SEP, k + 1).alias("inside"), "n").unionByName(longer.select(suffix(F.col("path")).alias("inside"), "n"))
            most = inside.groupBy("inside").agg(F.max("n").alias("n_longer"))
            here = here.join(most, here["path"] == most["inside"], "left").where(F.coalesce(100 * F.col("n_longer") < cover * F.col("n"), F.lit(True)))
        here = here.select("path", "n", "lefts", "rights")
        out = here if out is None else out.unionByName(here)
    cut = """array_min(transform(rights, (r, i) -> named_struct(
        'score', cast(1000000 as decimal(7, 0)) * cast(n as decimal(15, 0)) * cast(n as decimal(15, 0)) div (cast(lefts[i + 1] as decimal(15, 0)) * cast(r as decimal(15, 0))),
        'k', i, 'l', lefts[i + 1], 'r', r)))"""
    out = out.withColumn("cut", F.expr(cut))
    rest = F.substring(F.col("path"), F.length(F.substring_index("path", SEP, 1)) + 2, F.length("path"))
    return out.select(plain(F.substring_index("path", SEP, 1)).alias("lang"), plain(rest).alias("phrase"), F.col("n").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.element_at("lefts", 1).alias("n"), F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, top: int = TOP, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` by score and a (descending), then phrase (byte order).

    Ranked within parts of a language first, so that no task sorts a language's phrases: ``PARTS * top`` rows meet.
    """
    rows = candidates(docs, **how)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, 1 AS k, w[i] AS phrase FROM places
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM places WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 2 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
found AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, c AS a FROM f WHERE k >= 2 AND c >= 10),
parts AS (
  SELECT lang, phrase, k, a, 1 AS cut, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM found
  UNION ALL SELECT lang, phrase, k, a, 2, w[1] || ' ' || w[2], w[3] FROM found WHERE k = 3),
scored AS (
  SELECT p.lang, p.phrase, p.k, p.a, p.cut, l.c AS l, r.c AS r,
         CAST((CAST(1000000 AS HUGEINT) * p.a * p.a) // (CAST(l.c AS HUGEINT) * r.c) AS BIGINT) AS score
  FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = p.x JOIN f r ON r.lang = p.lang AND r.phrase = p.y
  QUALIFY row_number() OVER (PARTITION BY p.lang, p.phrase ORDER BY score, p.cut) = 1),
longer AS (
  SELECT lang, inside, max(a) AS most FROM (
    SELECT lang, a, w[1] || ' ' || w[2] AS inside FROM found WHERE k = 3
    UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM found WHERE k = 3) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, t.n, s.score
FROM scored s JOIN totals t ON t.lang = s.lang LEFT JOIN longer g ON g.lang = s.lang AND g.inside = s.phrase
WHERE g.most IS NULL OR 100 * g.most < 50 * s.a
QUALIFY rank <= 2000
"""
