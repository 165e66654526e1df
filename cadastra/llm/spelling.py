"""Spelling variants: a self-join of the vocabulary's trie at edit distance one.

Two nodes of a trie are active for one another if their paths are at distance one. With one edit such pairs come from two seeds only: two
children of a node (a replaced character), and a node and its child (an inserted one). From there a pair is propagated to
the children that both nodes have for the same character; where both nodes end a word, the words are near. Levels are
worked one after another, each as arrays.

The trie is partitioned by prefix. Words of seven characters at least that are one edit apart share their first three characters
or their last three, so that each word stands in two partitions, and its window (what the partition's words don't share) goes into
that partition's trie. A partition with too many characters is parted again: a pair whose shorter window has m
characters shares the first half of it or the last half, so that each row goes on under either, for the m of its own length and one less.
Windows halve, and those of one or two characters are bounded by the alphabet: no partition stays large, and no pair is lost.

Defined results: a null text has no words, a null id counts as empty in the hash; a repeated row counts again; a word's near words are
distinct; extra columns are not read; an empty table gives an empty result; ties go to the smallest in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.line_dedup import UPPER
from cadastra.runtime import Workspace, ship_package

#: Characters of a word, its least length and count, the share of words that lose a character, and how much commoner a form is.
WORD, SHORTEST, MIN_COUNT, DAMAGED, TIMES = "[A-Za-zÀ-ÿ]+", 7, 2, 31, 10
#: Characters both ends of a word are partitioned by: 2 * 3 < 7, so that one edit leaves one end whole.
END = 3
#: Characters of a partition that is parted again, and of the partitions that one trie holds.
LARGE, TOGETHER = 2_000_000, 1_000_000


def damaged_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = SHORTEST) -> DataFrame:
    """``word`` of each run of letters; where the hash of id and run is divisible by 31, without the character that the hash names.

    Runs that are too short with all their characters are left out.
    """
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))).alias("run"))
    # a run can't have more code points than bytes
    runs = runs.where(F.octet_length("run") >= shortest).select("id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    rest = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return runs.select(F.when(F.col("h") % DAMAGED == 0, rest).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = SHORTEST, min_count: int = MIN_COUNT) -> DataFrame:
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def near_in_tries(keys: np.ndarray, windows: list[str]) -> np.ndarray:
    """Pairs (two columns of row numbers) of windows with one ``keys`` number that are one edit apart, each once.

    Rows are sorted by key, then window; windows of a key are distinct.
    """
    count = len(windows)
    sizes = np.fromiter(map(len, windows), dtype=np.int64, count=count)
    starts = np.cumsum(sizes) - sizes
    chars = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    # node of each row's path at this level, by number in order; `word` is the row that ends at a node, or -1
    node = np.cumsum(np.r_[0, keys[1:] != keys[:-1]]) if count else np.zeros(0, dtype=np.int64)
    rows = np.arange(count)
    nodes = int(node[-1]) + 1 if count else 0
    word = np.full(nodes, -1)
    ended = sizes == 0
    word[node[ended]] = rows[ended]
    kin = np.zeros((0, 2), dtype=np.int64)  # pairs of nodes of this level, then (node, node one level below)
    found, steep, level = [], None, 0

    def descend(pairs: np.ndarray, upper: tuple, lower: tuple) -> np.ndarray:
        """Children, for one character, of both nodes of a pair."""
        key, first, size = upper
        below, _, _ = lower
        times = size[pairs[:, 0]]
        owner = np.repeat(np.arange(len(pairs)), times)
        child = np.repeat(first[pairs[:, 0]] - (np.cumsum(times) - times), times) + np.arange(len(owner))
        wanted = pairs[owner, 1] << 21 | key[child] & 0x1FFFFF
        place = np.searchsorted(below, wanted)
        hit = place < len(below)
        hit[hit] = below[place[hit]] == wanted[hit]
        return np.c_[child[hit], place[hit]]

    def grow(rows: np.ndarray, node: np.ndarray, nodes: int, level: int) -> tuple:
        """The next level: rows that go on, their nodes, (key, first, size) of the children, and the row that ends at each."""
        on = sizes[rows] > level
        rows, node = rows[on], node[on]
        key = node << 21 | chars[starts[rows] + level]
        fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, dtype=bool)
        child = np.cumsum(fresh) - 1
        keys = key[fresh]
        size = np.bincount(keys >> 21, minlength=nodes)
        first = np.cumsum(size) - size
        word = np.full(len(keys), -1)
        ended = sizes[rows] == level + 1
        word[child[ended]] = rows[ended]
        held = np.bincount(child, minlength=len(keys))
        return rows, child, (keys, first, size), word, held

    held = np.bincount(node, minlength=nodes)
    below = grow(rows, node, nodes, 0)
    while len(kin) or (steep is not None and len(steep)) or (held > 1).any():
        under_rows, under_node, children, under_word, under_held = below
        # a node with one row below it has no second word to pair
        own = np.flatnonzero(held[children[0] >> 21] > 1)
        seeds = np.c_[children[0][own] >> 21, own]
        if steep is None or not len(steep):
            steep = seeds
        else:
            # children of a node and its child may be node and child themselves: these are seeds
            steep = np.r_[seeds, steep[children[0][steep[:, 1]] >> 21 != steep[:, 0]]]
        for pairs, a, b in ((kin, word, word), (steep, word, under_word)):
            if len(pairs):
                x, y = a[pairs[:, 0]], b[pairs[:, 1]]
                both = (x >= 0) & (y >= 0)
                found.append(np.c_[x[both], y[both]])
        after = grow(under_rows, under_node, len(children[0]), level + 1)
        kin = descend(kin, children, children)
        # sisters: every pair of children of one node, bounded by the alphabet
        families = children[2][children[0] >> 21]
        place = np.arange(len(children[0]))
        younger = children[1][children[0] >> 21] + families - 1 - place
        owner = np.repeat(place, younger)
        sister = np.arange(len(owner)) - np.repeat(np.cumsum(younger) - younger, younger) + owner + 1
        kin = np.r_[kin, np.c_[owner, sister]]
        steep = descend(steep, children, after[2])
        word, held, below, level = under_word, under_held, after, level + 1
    return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, near, n_near for both directions of each pair; rows come sorted by partition and window."""

    def joined(keys: list[str], windows: list[str], words: list[str], counts: list[int]) -> Iterator[pa.RecordBatch]:
        numbers = np.cumsum([0, *(a != b for a, b in zip(keys, keys[1:], strict=False))])
        pairs = near_in_tries(numbers, windows)
        names, n = pa.array(words, pa.string()), pa.array(counts, pa.int64())
        for start in range(0, len(pairs), 50_000):
            x, y = (pa.array(pairs[start : start + 50_000, i]) for i in (0, 1))
            for a, b in ((x, y), (y, x)):
                yield pa.record_batch([names.take(a), names.take(b), n.take(b)], names=["word", "near", "n_near"])

    held: tuple[list, list, list, list] = ([], [], [], [])
    size = 0
    for batch in batches:
        for key, window, word, n in zip(*(batch.column(c).to_pylist() for c in ("part", "window", "word", "n")), strict=True):
            if size > TOGETHER and key != held[0][-1]:
                yield from joined(*held)
                held, size = ([], [], [], []), 0
            for column, value in zip(held, (key, window, word, n), strict=True):
                column.append(value)
            size += len(window) + 1
    if held[0]:
        yield from joined(*held)


def partitions(words: DataFrame, workspace: Workspace, large: int = LARGE) -> DataFrame:
    """``part``, ``window``, ``word``, ``n``: rows whose windows may be near within ``part``, no part of more than ``large`` characters unless windows can't be parted."""
    size = F.char_length("word")
    cut = lambda at, length: F.substring(F.col("word"), at, length)
    first = words.select("word", "n", F.concat(F.lit("F "), cut(F.lit(1), F.lit(END))).alias("part"), cut(F.lit(END + 1), size).alias("window"))
    last = words.select("word", "n", F.concat(F.lit("L "), cut(size - END + 1, F.lit(END))).alias("part"), cut(F.lit(1), size - END).alias("window"))
    # shorter: characters of the shorter windows of a pair in this part, where all pairs of a part have the same
    open_rows = workspace.save(first.unionByName(last).withColumn("shorter", F.lit(None).cast("int")), "parts0")
    done: DataFrame | None = None
    number = 0
    while True:
        sums = open_rows.groupBy("part").agg(F.sum(F.char_length("window")).alias("chars"), F.count(F.lit(1)).alias("rows"), F.max("shorter").alias("most"))
        # a word alone has no partner, however long it is
        hot = workspace.save(sums.where((F.col("chars") > large) & (F.col("rows") > 1) & (F.coalesce("most", F.lit(2)) > 1)).select("part"), f"hot{number}")
        if hot.isEmpty():
            return open_rows if done is None else done.unionByName(open_rows)
        # few rows: each stands for more than `large` characters of windows
        calm = open_rows.join(hot, "part", "left_anti")
        done = calm if done is None else done.unionByName(calm)
        length = F.char_length("window")
        split = open_rows.join(hot, "part", "left_semi")
        split = split.withColumn("m", F.explode(F.when(F.col("shorter").isNull(), F.array(length, length - 1)).otherwise(F.array("shorter")))).where("m >= 0")
        half = (F.col("m") / 2).cast("int")
        other = F.col("m") - half
        piece = lambda at, size: F.substring(F.col("window"), at, size)
        ahead = split.select("word", "n", F.concat_ws(" ", "part", F.concat(F.lit("F"), F.col("m").cast("string")), piece(F.lit(1), half)).alias("part"), piece(half + 1, length).alias("window"), other.alias("shorter"))
        behind = split.where("m > 1").select("word", "n", F.concat_ws(" ", "part", F.concat(F.lit("L"), F.col("m").cast("string")), piece(length - other + 1, other)).alias("part"), piece(F.lit(1), length - other).alias("window"), half.alias("shorter"))
        number += 1
        open_rows = workspace.save(ahead.unionByName(behind), f"parts{number}")


def near_words(words: DataFrame, workspace: Workspace, large: int = LARGE) -> DataFrame:
    """``word``, ``near``, ``n_near``: pairs of ``words`` one edit apart, in both directions; a pair may come more than once."""
    ship_package(words.sparkSession)
    parts = partitions(words, workspace, large)
    dealt = parts.select("part", "window", "word", "n").repartition("part").sortWithinPartitions("part", "window")
    return dealt.mapInArrow(_near_pairs, "word string, near string, n_near long")


def spelling_forms(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", times: int = TIMES, large: int = LARGE) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``docs``."""
    workspace = Workspace(docs.sparkSession, "spelling")
    words = workspace.save(vocabulary(damaged_runs(docs, text, doc_id)), "words")
    # a word has few near words: an edit at one of its places, with a letter
    pairs = near_words(words, workspace, large)
    sets = pairs.groupBy("word").agg(F.collect_set(F.struct((-F.col("n_near")).alias("less"), "near")).alias("all"))
    best = sets.select("word", F.size("all").cast("long").alias("n_near"), F.array_min("all").alias("best"))
    known = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    known = workspace.save(known, "known")
    # a form is ten times as common as its word: steps double until the last is reached, after log2(log10(n)) rounds
    steps = workspace.save(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "steps0")
    number = 0
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        number += 1
        moved = workspace.save(moved, f"steps{number}")
        steps = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return known.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(spark.read.parquet(f"{sf_dir}/documents.parquet"))
