"""Substring deduplication by MinHash banding of paragraphs.

A paragraph is a run of words between content-defined cuts: a cut stands before a word whose pair hash is the least of
``REACH`` words to either side. So a passage that is inserted anywhere is cut alike in every document that holds it,
whatever stands around it; one of 51 words has about three whole paragraphs inside. A paragraph's five-word shingles
are min-hashed in ``BANDS`` bands of ``ROWS``: equal paragraphs always collide, edited ones with a Jaccard similarity of
0.8 with a probability of 0.76.

Each bucket is led by its smallest document. Every other paragraph of the bucket is held against the leader's: what lies
``MARGIN`` words around the colliding paragraphs of two documents is aligned at equal shingles, and runs are carried on
over changes of up to four words (replaced, inserted or dropped) while these are few. A passage is verified exactly: at
least ``MIN_WORDS`` words, a Jaccard similarity of at least 0.8 over its five-word shingles, and no fewer than half as
many distinct shingles as words in ``MIN_WORDS`` (a word said over and over is no passage).

A paragraph that lies in no passage shared with its leader goes on to narrower buckets, its leader to none (``LEVELS``):

1. those of its band key and the ``BESIDE`` words before it, or after it, so that a line which thousands of unlike
   documents hold parts into its contexts; these buckets are led ``AGAIN`` times, each time by the least that is left;
2. those of every verbatim run of ``MIN_WORDS`` words that contains it. Whoever meets here shares a passage with the
   leader, so nothing is left open: passages with a verbatim run of ``MIN_WORDS`` words around a whole paragraph are found
   whatever else holds their lines. Passages that are edited throughout are found at the levels before.

The copy in the larger id is removed, so the smallest id keeps the passage. Removals that overlap or are linked form
components. No pairs within a bucket are made: each level compares a row with one leader.

Texts are dealt once, by document, and stay there; each level moves only what it asks for and the stretches that are compared. Buckets
are led in one exchange by ranges of key and document, so that a hot bucket goes to many tasks.

Defined results: null and empty texts have no passages; words are separated by ASCII white space and compared with A-Z
lowered; rows of one id are one document (its distinct texts each matter); passages that repeat within one document only
stay; a null id takes no part. Extra columns pass through ``remove_passages``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastra.llm.graph import connected_components
from cadastra.llm.shingles import STEP, WORDS, common, grouped, mixed, windows
from cadastra.runtime import Workspace, one_of, ship_package

WIDTH, MIN_WORDS, PERCENT = 5, 50, 80
REACH, LONGEST, BANDS, ROWS = 5, 64, 2, 3
#: Words around colliding paragraphs that are compared; starts and ends are rounded outwards to ``GRID``, so that they are often the same.
MARGIN, GRID = 80, 32
#: Words beside a paragraph that must be equal at the second level, and how often its buckets are led.
BESIDE, AGAIN = 10, 3
#: What the buckets of each round are made of.
PARAGRAPH, CONTEXT, VERBATIM = 0, 1, 2
LEVELS = (PARAGRAPH, *[CONTEXT] * AGAIN, VERBATIM)
FACTORS = np.random.default_rng(23).integers(1, 2**63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: A place is a text's checksum and a word's number in one long.
PLACE = 1 << 31
#: Words of texts that are hashed and cut together.
BATCH_BYTES = 1_000_000


def paragraphs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, words, keys) of every paragraph of at least ``WIDTH`` words, ``keys`` with one row for each band.

    All texts are laid out in one array, so far apart that nothing reaches from one into the next.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    gap = np.zeros(2 * REACH + WIDTH, dtype=np.uint64)
    begins = np.cumsum(sizes + len(gap)) - sizes - len(gap)
    flat = np.concatenate([x for t in texts for x in (t, gap)]) if len(texts) else gap
    inner = np.zeros(len(flat), dtype=bool)
    for begin, size in zip(begins.tolist(), sizes.tolist(), strict=True):
        inner[begin : begin + size - 1] = size > 2 * REACH + 1
    highest = np.iinfo(np.uint64).max
    pair = np.where(inner[:-1], windows(flat, 2), highest)
    full = np.full(len(pair) + 2 * REACH, highest, dtype=np.uint64)
    full[REACH:-REACH] = pair
    left = np.minimum.reduce([full[i : i + len(pair)] for i in range(REACH)])
    right = np.minimum.reduce([full[REACH + 1 + i : REACH + 1 + i + len(pair)] for i in range(REACH)])
    found = np.flatnonzero((pair < left) & (pair <= right))
    starts = np.union1d(found, begins[sizes > 0])
    owner = np.searchsorted(begins, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(flat)), begins[owner] + sizes[owner])
    # words that repeat have no least one
    parts = -(-(ends - starts) // LONGEST)
    first = np.cumsum(parts) - parts
    owner, last = np.repeat(owner, parts), np.repeat(ends, parts)
    starts = np.repeat(starts, parts) + LONGEST * (np.arange(len(owner)) - np.repeat(first, parts))
    ends = np.minimum(starts + LONGEST, last) - (WIDTH - 1)
    long = ends > starts
    owner, starts, ends = owner[long], starts[long], ends[long]
    if not len(starts):
        return owner, starts, ends, np.zeros((BANDS, 0), dtype=np.uint64)
    shingles = np.append(windows(flat, WIDTH), np.uint64(0))
    # a word said over and over is no passage
    again = np.append((shingles[1:] == shingles[:-1]).astype(np.int64), 0)
    varied = 4 * np.add.reduceat(again, np.stack([starts, ends], 1).ravel())[::2] <= ends - starts
    owner, starts, ends = owner[varied], starts[varied], ends[varied]
    spans = np.stack([starts, ends], 1).ravel()
    keys = np.empty((BANDS, len(starts)), dtype=np.uint64)
    for band, factors in enumerate(FACTORS):
        key = np.full(len(starts), np.uint64(band), dtype=np.uint64)
        for f in factors:
            if len(spans):
                key = mixed(key * STEP + np.minimum.reduceat(shingles * f, spans)[::2])
        keys[band] = key
    return owner, starts - begins[owner], ends - starts + WIDTH - 1, keys


def band_keys(words: np.ndarray) -> np.ndarray:
    return np.unique(paragraphs([words])[3])


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Words from the start on that are equal."""
    n = min(len(a), len(b))
    if not n:
        return 0
    wrong = a[:n] != b[:n]
    first = int(wrong.argmax())
    return first if wrong[first] else n


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order: ``np.unique``, which takes several times as long for a hundred of them."""
    values = np.sort(values)
    fresh = np.empty(len(values), dtype=bool)
    fresh[:1] = True
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values[fresh]


def _run_length(a: np.ndarray, b: np.ndarray) -> int:
    """Words of two sequences from their start on that are equal but for single changed words.

    A change is passed over if six words after it are equal; changes are at most one in twenty words, and one more.
    """
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    at, changes, block = 0, 0, 64
    while at < n:
        equal = _same(a[at : at + block], b[at : at + block])
        if equal == min(block, n - at):
            at, block = at + equal, 2 * block
            continue
        stop = at + equal
        if stop + 7 > n or (a[stop + 1 : stop + 7] != b[stop + 1 : stop + 7]).any() or changes + 1 > 1 + stop / 20:
            return stop
        changes += 1
        at = stop + 7
    return n


#: Words of either text that a longer change may have, nearest first.
GAPS = sorted(((m, n) for m in range(5) for n in range(5) if m or n), key=lambda g: (g[0] + g[1], abs(g[0] - g[1])))


def _extent(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Words of either sequence as in ``_run_length``, but a change may also insert, drop or replace up to four words."""
    at, bt, changes, block = 0, 0, 0, 64
    while n := min(block, len(a) - at, len(b) - bt):
        equal = _same(a[at : at + n], b[bt : bt + n])
        at, bt = at + equal, bt + equal
        if equal == n:
            block = 2 * block
            continue
        x, y = a[at : at + 10].tolist(), b[bt : bt + 10].tolist()
        # most ends have no word in common that a change could stop at
        stops = min(len(x), len(y)) >= 6 and not set(x[:5]).isdisjoint(y[:5])
        gap = next(((m, n) for m, n in GAPS if x[m] == y[n] and len(x) >= m + 6 and x[m : m + 6] == y[n : n + 6]), None) if stops else None
        if gap is None or changes > at / 20:
            break
        changes += 1
        at, bt = at + gap[0] + 6, bt + gap[1] + 6
    return at, bt


class Indexed:
    """A text's word hashes, and its shingles in order of their hashes (``shingles``, if they are known)."""

    def __init__(self, words: np.ndarray, shingles: np.ndarray | None = None) -> None:
        self.words, self.windows = words, windows(words, WIDTH) if shingles is None else shingles
        self.order = np.argsort(self.windows, kind="stable")
        self.sorted = self.windows[self.order]


def aligned(a: np.ndarray, held: Indexed, min_words: int = MIN_WORDS, percent: int = PERCENT, shingles: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(start in a, start in b, words in a, words in b) of what a has in common with the text b that ``held`` indexes."""
    b, wb, order = held.words, held.windows, held.order
    if min(len(a), len(b)) < min_words:
        return []
    wa = windows(a, WIDTH) if shingles is None else shingles
    if len(a) == len(b) and (a == b).all():
        return [(0, 0, len(a), len(b))] if 2 * len(_distinct(wa)) >= min_words else []
    place = np.searchsorted(held.sorted, wa)
    place[place == len(wb)] = 0
    present = held.sorted[place] == wa
    # a passage shares all but a fifth of its shingles, so that some stretch of ``span`` of them lacks two fifths at most
    span = min_words - WIDTH + 1
    have = np.cumsum(np.append(0, present))
    dense = have[span:] - have[:-span] >= (2 * percent - 100) / 100 * span
    # and has half as many distinct ones as words
    if not dense.any() or 2 * len(_distinct(wa[present])) * 100 < percent * min_words:
        return []
    near = np.cumsum(np.concatenate([np.zeros(span, dtype=np.int64), dense, np.zeros(span - 1, dtype=np.int64)]))
    close = near[span:] - near[:-span] > 0
    fresh = np.empty(len(wa), dtype=bool)
    fresh[0] = wa[0] != 0
    np.not_equal(wa[1:], wa[:-1], out=fresh[1:])
    hits = (present & close & fresh).nonzero()[0]
    out: list[tuple[int, int, int, int]] = []

    def verified(i: int, j: int, m: int, n: int) -> bool:
        if min(m, n) < min_words:
            return False
        sa, sb = _distinct(wa[i : i + m - WIDTH + 1]), _distinct(wb[j : j + n - WIDTH + 1])
        shared = common(sa, sb)
        return 100 * shared >= percent * (len(sa) + len(sb) - shared) and 2 * len(sa) >= min_words

    at, tried = 0, {}
    for i in hits.tolist():
        j = int(order[place[i]])
        # another place in b may hold more than one that was tried in vain
        if i < at or i < tried.get(j - i, 0):
            continue
        (before, back), (after, on) = _extent(a[:i][::-1], b[:j][::-1]), _extent(a[i:], b[j:])
        span = i - before, j - back, before + after, back + on
        found = verified(*span)
        if not found and min(span[2:]) >= min_words:
            # fewer changes may hold where more don't
            before, after = _run_length(a[:i][::-1], b[:j][::-1]), _run_length(a[i:], b[j:])
            span = i - before, j - before, before + after, before + after
            found = verified(*span)
        if found:
            out.append(span)
            at = i + after
        else:
            # changes count from where a run is entered, so each verbatim stretch of a long one is a start of its own
            same = _same(a[i:], b[j:]) if min(span[2:]) >= min_words else after
            tried[j - i] = i + max(1, same - WIDTH + 1)
    return out


def passages(a: np.ndarray, held: Indexed, min_words: int = MIN_WORDS, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(start in a, start in b, words in a) of ``aligned``."""
    return [found[:3] for found in aligned(a, held, min_words, percent)]


def _keys(docs: DataFrame) -> DataFrame:
    """key, doc_id, place, words of every paragraph in every band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in grouped(batch.column("text").to_pylist(), BATCH_BYTES):
                ids = batch.column("doc_id").slice(at, len(texts))
                at += len(texts)
                owner, starts, words, keys = paragraphs(WORDS.of(texts))
                places = np.array([zlib.crc32(t) for t in texts], dtype=np.int64)[owner] * PLACE + starts
                columns = [keys.ravel().view(np.int64), np.tile(places, BANDS), np.tile(words, BANDS).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.tile(owner, BANDS))), *map(pa.array, columns)], names=["doc_id", "key", "place", "words"])

    return docs.mapInArrow(run, "doc_id long, key long, place long, words int")


LED = "a long, place long, key long, words int, b long, b_place long, open boolean"


class _Leaders:
    """Leads the buckets of one range of rows, sorted by key, document and place, batch by batch.

    The bucket that the range begins with may have begun before, so that its rows are left open; so is the leader of the last one,
    which may go on. A leader's other rows wait until another document shows up in their bucket. A row that comes twice counts once.
    """

    def __init__(self) -> None:
        self.first: int | None = None
        self.last: tuple[int, int, int] | None = None
        self.key, self.lead, self.place, self.words, self.others = None, 0, 0, 0, False
        self.waiting: list[tuple[int, int]] = []

    def _out(self, *columns: np.ndarray, open: bool = False, own: bool = False) -> pa.RecordBatch:  # noqa: A002
        doc, place, key, words, lead, lead_place = columns
        none = np.full(len(doc), open or own)
        arrays = [pa.array(doc), pa.array(place), pa.array(key), pa.array(words.astype(np.int32)), pa.array(lead, mask=none), pa.array(lead_place, mask=none), pa.array(np.full(len(doc), open))]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "place", "key", "words", "b", "b_place", "open"])

    def _own(self, open: bool = False) -> pa.RecordBatch:  # noqa: A002
        rows = [*([(self.place, self.words)] if open else []), *self.waiting]
        self.waiting = []
        same = lambda value: np.full(len(rows), value, dtype=np.int64)
        return self._out(same(self.lead), np.array([p for p, _ in rows], dtype=np.int64), same(self.key), np.array([w for _, w in rows], dtype=np.int64), same(0), same(0), open=open, own=not open)

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, doc, place, words = (batch.column(c).to_numpy() for c in ("key", "doc_id", "place", "words"))
        if not len(key):
            return
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
        fresh[0] = self.last != (int(key[0]), int(doc[0]), int(place[0]))
        self.last = int(key[-1]), int(doc[-1]), int(place[-1])
        if not fresh.all():
            key, doc, place, words = key[fresh], doc[fresh], place[fresh], words[fresh]
            if not len(key):
                return
        if self.first is None:
            self.first = int(key[0])
        skip = int(np.searchsorted(key, self.first, side="right")) if key[0] == self.first else 0
        if skip:
            part = slice(0, skip)
            yield self._out(doc[part], place[part], key[part], words[part], doc[part], place[part], open=True)
            key, doc, place, words = key[skip:], doc[skip:], place[skip:], words[skip:]
            if not len(key):
                return
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        goes_on = self.key is not None and int(key[0]) == self.key
        if not goes_on:
            self.waiting = []
        sizes = np.diff(np.r_[starts, len(key)])
        lead, lead_place = np.repeat(doc[starts], sizes), np.repeat(place[starts], sizes)
        if goes_on:
            lead[: sizes[0]], lead_place[: sizes[0]] = self.lead, self.place
        other = doc != lead
        mixed_ = np.repeat(np.add.reduceat(other, starts) > 0, sizes)
        own = ~other
        own[starts[1:] if goes_on else starts] = False
        if goes_on and other[: sizes[0]].any() and self.waiting:
            yield self._own()
        if goes_on and self.others:
            mixed_[: sizes[0]] = True
        at = np.flatnonzero(other)
        yield self._out(doc[at], place[at], key[at], words[at], lead[at], lead_place[at])
        at = np.flatnonzero(own & mixed_)
        yield self._out(doc[at], place[at], key[at], words[at], lead[at], lead_place[at], own=True)
        last = starts[-1]
        if not (goes_on and last == 0):
            self.key, self.lead, self.place, self.words, self.others, self.waiting = int(key[last]), int(doc[last]), int(place[last]), int(words[last]), False, []
        self.others |= bool(other[last:].any())
        if not self.others:
            at = np.flatnonzero(own[last:]) + last
            self.waiting += list(zip(place[at].tolist(), words[at].tolist(), strict=True))

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.key is not None:
            yield self._own(open=True)


def _led(rows: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    """Rows of buckets that hold several documents: a, place, key, words; b, b_place: the leader and where (null in the leader's own rows).

    One exchange: rows are dealt by ranges of key and document, so that a hot bucket goes to many tasks, and led in their order. What a range
    can't know by itself are at most two buckets of it, whose leaders come from a map of the buckets that two ranges or more share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders = _Leaders()
        for batch in batches:
            yield from leaders.add(batch)
        yield from leaders.end()

    order = ["key", "doc_id", "place"]
    led = workspace.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, LED), name)
    # the least place decides where a leader holds a key twice
    ends = led.where("open").groupBy("key").agg(F.min(F.struct("a", "place")).alias("least"), F.max("a").alias("most")).where("least.a < most")
    # a bucket for each range at most, so that one value holds them all and no row is joined
    leads = ends.agg(F.map_from_entries(F.collect_list(F.struct("key", "least")))).scalar()
    whole = led.withColumn("lead", F.when(F.col("open"), F.element_at(leads, F.col("key")))).where("NOT open OR (lead IS NOT NULL AND (a <> lead.a OR place <> lead.place))")
    led_by = lambda mine, known: F.when(~F.col("open"), F.col(known)).when(F.col("a") != F.col("lead.a"), F.col(f"lead.{mine}"))
    return whole.select("a", "place", "key", "words", led_by("a", "b").alias("b"), led_by("place", "b_place").alias("b_place"))


#: Bytes of stretches that are handed on together.
STRETCH_BYTES = 4 << 20
JOBS = "a long, a_part long, a_lo int, b long, b_part long, b_lo int, b_hi int, places array<struct<key:long,at:int,words:int>>, mine binary"


def _jobs(texts: DataFrame, led: DataFrame, margin: int) -> DataFrame:
    """Pairs of stretches of two documents that are to be compared, with the colliding paragraphs inside and the words of the first.

    ``texts`` lies by document already, so that only the led rows move, once.
    """
    at = lambda c: F.pmod(F.col(c), F.lit(PLACE)).cast("int")
    row = F.struct(F.shiftright("place", 31).alias("part"), at("place").alias("at"), "words", "key", "b", F.shiftright("b_place", 31).alias("b_part"), at("b_place").alias("b_at"))
    asked = led.groupBy(F.col("a").alias("doc_id")).agg(F.collect_list(row).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("asked")
            inner = lists.flatten()
            fields = {inner.type.field(i).name: f for i, f in enumerate(inner.flatten())}
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            # rows of one id may be several texts
            mine = np.flatnonzero(fields["part"].to_numpy() == batch.column("part").to_numpy()[owner])
            if not len(mine):
                continue
            columns = [fields[c].fill_null(0).to_numpy()[mine] for c in ("key", "b_at", "at", "b_part", "b", "words")]
            alone, owner = fields["b"].is_null().to_numpy(zero_copy_only=False)[mine], owner[mine]
            order = np.lexsort((*columns[:5], alone, owner))
            key, b_at, at, b_part, b, words, alone, owner = (c[order] for c in (*columns, alone, owner))
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (np.diff(owner) != 0) | (alone[1:] != alone[:-1]) | (b[1:] != b[:-1]) | (b_part[1:] != b_part[:-1])
            fresh[1:] |= (at[1:] - at[:-1] - words[:-1] > 2 * margin) | ((np.abs(np.diff(b_at) - np.diff(at)) > margin) & ~alone[1:])
            begins = np.flatnonzero(fresh)
            ends, of, none = np.append(begins[1:], len(at)), owner[begins], alone[begins]
            low, b_low = (np.maximum(np.minimum.reduceat(place, begins) - margin, 0) // GRID * GRID for place in (at, b_at))
            high, b_high = (-(-(np.maximum.reduceat(place + words, begins) + margin) // GRID) * GRID for place in (at, b_at))

            def handed(i: int, j: int, data: list[bytes], batch: pa.RecordBatch = batch, begins: np.ndarray = begins, ends: np.ndarray = ends, places: tuple = (key, at, words), theirs: tuple = (b[begins], b_part[begins], b_low, b_high), of: np.ndarray = of, low: np.ndarray = low, none: np.ndarray = none) -> pa.RecordBatch:
                rows, inner = pa.array(of[i:j]), slice(begins[i], ends[j - 1])
                lists = pa.ListArray.from_arrays(pa.array((np.append(begins[i:j], ends[j - 1]) - begins[i]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(c[inner]) for c in places], names=["key", "at", "words"]))
                other = [pa.array(c[i:j].astype(kind), mask=none[i:j]) for c, kind in zip(theirs, (np.int64, np.int64, np.int32, np.int32), strict=True)]
                columns = [batch.column("doc_id").take(rows), batch.column("part").take(rows), pa.array(low[i:j].astype(np.int32)), *other, lists, pa.array(data, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=["a", "a_part", "a_lo", "b", "b_part", "b_lo", "b_hi", "places", "mine"])

            last, split, data, begin, size = -1, [], [], 0, 0
            for i, (text, lo, hi) in enumerate(zip(of.tolist(), low.tolist(), high.tolist(), strict=True)):
                if text != last:
                    last, split = text, batch.column("text")[text].as_py().lower().split()
                data.append(b" ".join(split[lo:hi]))
                size += len(data[-1])
                if size > STRETCH_BYTES:
                    yield handed(begin, i + 1, data)
                    data, begin, size = [], i + 1, 0
            if data:
                yield handed(begin, len(of), data)

    return texts.join(asked, "doc_id").select("doc_id", "part", "text", "asked").mapInArrow(run, JOBS)


def _with_theirs(texts: DataFrame, jobs: DataFrame) -> DataFrame:
    """``jobs`` with the words of the leader's stretch (null where there is no leader to compare with), which move once."""
    asked = jobs.where("b IS NOT NULL").groupBy(F.col("b").alias("doc_id")).agg(F.collect_set(F.struct(F.col("b_part").alias("part"), F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"))).alias("asked"))
    names = ["b", "b_part", "b_lo", "b_hi", "theirs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("asked")
            part, low, high = lists.flatten().flatten()
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = np.flatnonzero(part.to_numpy() == batch.column("part").to_numpy()[owner])
            owner, text = owner[at], batch.column("text")
            last, words, data, begin, size = -1, [], [], 0, 0

            def cut(rows: np.ndarray, of: np.ndarray, data: list[bytes], doc: pa.Array = batch.column("doc_id"), asked: tuple = (part, low, high)) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([doc.take(pa.array(of)), *(c.take(pa.array(rows)) for c in asked), pa.array(data, pa.binary())], names=names)

            for i, (of, lo, hi) in enumerate(zip(owner.tolist(), low.to_numpy()[at].tolist(), high.to_numpy()[at].tolist(), strict=True)):
                if of != last:
                    last, words = of, text[of].as_py().lower().split()
                data.append(b" ".join(words[lo:hi]))
                size += len(data[-1])
                if size > STRETCH_BYTES:
                    yield cut(at[begin : i + 1], owner[begin : i + 1], data)
                    data, begin, size = [], i + 1, 0
            yield cut(at[begin:], owner[begin:], data)

    theirs = texts.join(asked, "doc_id").select("doc_id", "part", "text", "asked").mapInArrow(run, "b long, b_part long, b_lo int, b_hi int, theirs binary")
    return jobs.join(theirs, names[:4], "left")


class Laid:
    """Word hashes of many texts in one array, with where each begins and how many it has; windows are made of all at once."""

    def __init__(self, texts: list[bytes]) -> None:
        parts = WORDS.of(texts)
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.words = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        self.shingles = windows(self.words, WIDTH)

    def of(self, text: int) -> np.ndarray:
        return self.words[self.begins[text] : self.begins[text] + self.sizes[text]]

    def shingles_of(self, text: int) -> np.ndarray:
        n = int(self.sizes[text])
        return self.shingles[self.begins[text] : self.begins[text] + n - WIDTH + 1] if n >= WIDTH else windows(self.of(text), WIDTH)


def _verbatim(laid: Laid, text: np.ndarray, row: np.ndarray, at: np.ndarray, size: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, start, words) of every run of ``min_words`` words that contains one of the places or lies in it, once a row (in whose order they are)."""
    runs = laid.sizes[text] - min_words + 1
    within = size <= min_words
    first, last = np.where(within, at + size - min_words, at), np.where(within, at, at + size - min_words)
    first, last = np.maximum(first, 0), np.minimum(last, runs - 1)
    some = last >= first
    row, text, first, last = row[some], text[some], first[some], last[some]
    counts = last - first + 1
    starts = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    row, text = np.repeat(row, counts), np.repeat(text, counts)
    order = np.lexsort((starts, row))
    row, text, starts = row[order], text[order], starts[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (np.diff(row) != 0) | (np.diff(starts) != 0)
    row, text, starts = row[fresh], text[fresh], starts[fresh]
    # windows of the texts that are asked for only
    used, place = np.unique(text, return_inverse=True)
    flat = np.concatenate([laid.of(t) for t in used.tolist()]) if len(used) else laid.words[:0]
    begins = np.cumsum(laid.sizes[used]) - laid.sizes[used]
    keys = windows(flat, min_words)[begins[place] + starts] if len(row) else laid.words[:0]
    return row, keys.view(np.int64), starts, np.full(len(row), min_words)


def _beside(laid: Laid, text: np.ndarray, row: np.ndarray, key: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, start, words) of paragraphs in the buckets of their keys and the words on either side."""
    beside = windows(laid.words, BESIDE)
    out = []
    for side, begin in ((1, at - BESIDE), (2, at + size)):
        some = (begin >= 0) & (begin + BESIDE <= laid.sizes[text])
        context = beside[laid.begins[text[some]] + begin[some]] + np.uint64(side)
        out.append((row[some], mixed(mixed(context) * STEP + key[some].view(np.uint64)).view(np.int64), at[some], size[some]))
    return tuple(np.concatenate(columns) for columns in zip(*out, strict=True))


#: Bytes of stretches that are compared together.
COMPARED_BYTES = 2 << 20


def _compared(whole: DataFrame, level: int, onward: int | None, min_words: int, percent: int) -> DataFrame:
    """Verified passages (a, part, b, a_start, b_start, words, b_words), and, with a ``key``, rows (a, place, words) of the next round."""
    names = ["a", "part", "b", "a_start", "b_start", "words", "b_words", "key", "place"]

    def compared(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        mine, theirs = batch.column("mine").to_pylist(), batch.column("theirs").to_pylist()
        texts = {t: i for i, t in enumerate(dict.fromkeys(t for t in (*mine, *theirs) if t is not None))}
        laid = Laid(list(texts))
        text = np.array([texts[t] for t in mine], dtype=np.int64)
        a, part, low, b_low = (batch.column(c).fill_null(0).to_numpy().astype(np.int64) for c in ("a", "a_part", "a_lo", "b_lo"))
        lists = batch.column("places")
        ends = np.cumsum(lists.value_lengths().to_numpy())
        key, at, size = (c.to_numpy().astype(np.int64) for c in lists.flatten().flatten())
        open_ = np.ones(len(key), dtype=bool)
        found: list[tuple[int, int, int, int, int]] = []
        last, held = -1, None
        for i, other in enumerate(theirs):
            if other is None:
                continue
            if last != texts[other]:
                last = texts[other]
                held = Indexed(laid.of(last), laid.shingles_of(last))
            spans = aligned(laid.of(text[i]), held, min_words, percent, laid.shingles_of(text[i]))
            own = slice(ends[i - 1] if i else 0, ends[i])
            for start, b_start, words, b_words in spans:
                begin = int(low[i]) + start
                found.append((i, begin, int(b_low[i]) + b_start, words, b_words))
                open_[own] &= (at[own] < begin) | (at[own] + size[own] > begin + words)
        row, *spans = np.array(found, dtype=np.int64).reshape(-1, 5).T
        columns = [pa.array(a[row]), pa.array(part[row]), batch.column("b").take(pa.array(row)), *map(pa.array, spans)]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int64())], names=names)
        if onward is None or not open_.any():
            return
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())[open_]
        key, at, size = key[open_], at[open_] - low[row], size[open_]
        if onward == VERBATIM:
            row, key, at, size = _verbatim(laid, text[row], row, at, size, min_words)
        elif onward != level:
            row, key, at, size = _beside(laid, text[row], row, key, at, size)
        none = pa.nulls(len(row), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a[row]), pa.array(part[row]), none, none, none, pa.array(size), none, pa.array(key), pa.array(part[row] * PLACE + low[row] + at)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy().astype(np.int64) for c in ("mine", "theirs"))
            group = np.cumsum(sizes) // COMPARED_BYTES
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                yield from compared(batch.slice(begin, end - begin))

    return whole.select("a", "a_part", "a_lo", "b", "b_lo", "places", "mine", "theirs").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def find_matches(docs: DataFrame, workspace: Workspace, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """a, b (a > b), a_start, b_start, words, b_words: verified passages that document a shares with b, in words from 0."""
    ship_package(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    # the texts are dealt once, by document; all levels read them where they lie
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.repartition(parts, "doc_id").withColumn("part", F.crc32("text")).dropDuplicates(["doc_id", "part"])
    texts = workspace.save_buckets(texts, "texts", parts, ["doc_id"])
    rows = workspace.save(_keys(texts), "rows0")
    out: DataFrame | None = None
    for number, level in enumerate(LEVELS):
        onward = LEVELS[number + 1] if number + 1 < len(LEVELS) else None
        jobs = workspace.save(_jobs(texts, _led(rows, workspace, f"led{number}"), max(MARGIN, min_words + GRID)), f"jobs{number}")
        if number == 0:
            workspace.drop("rows0")
        found = workspace.save(_compared(_with_theirs(texts, jobs), level, onward, min_words, percent), f"found{number}")
        workspace.drop(f"jobs{number}", f"led{number}")
        matches = found.where("key IS NULL").select("a", "b", "a_start", "b_start", "words", "b_words")
        out = matches if out is None else out.unionByName(matches)
        rows = found.where("key IS NOT NULL").select("key", F.col("a").alias("doc_id"), "place", F.col("words").cast("int").alias("words"))
        if onward is None or rows.isEmpty():
            break
    return out


def clustered(matches: DataFrame, workspace: Workspace) -> DataFrame:
    """doc_id, start, words, kept, component_id (smallest document of the component) of every passage, overlaps merged."""
    ends = matches.withColumns({"a_end": F.col("a_start") + F.col("words"), "b_end": F.col("b_start") + F.col("b_words")})
    side = lambda own, other, kept: F.struct(F.col(own).alias("doc_id"), F.struct(F.col(f"{own}_start").alias("s"), F.col(f"{own}_end").alias("e"), F.lit(kept).alias("kept"), *(other(c) for c in ("b", "b_start", "b_end"))).alias("x"))
    sides = ends.select(F.inline(F.array(side("a", F.col, False), side("b", lambda c: F.lit(None).cast("long").alias(c), True))))
    # equal sides are one before they are moved: what many documents have in common with b is one row of b
    sides = sides.groupBy("doc_id").agg(F.collect_set("x").alias("xs")).select("doc_id", F.inline("xs"))
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = sides.withColumn("fresh", F.coalesce((F.col("s") >= reached).cast("int"), F.lit(1)))
    marked = marked.withColumn("no", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marked = workspace.save(marked.withColumn("node", F.xxhash64("doc_id", "no")), "sides")
    dst = marked.where("kept").select(F.col("doc_id").alias("b"), F.col("s").alias("b_start"), F.col("e").alias("b_end"), F.col("node").alias("dst"))
    edges = marked.where("NOT kept").select(F.col("node").alias("src"), "b", "b_start", "b_end").join(dst, ["b", "b_start", "b_end"]).select("src", "dst")
    components = connected_components(edges, workspace, "passages")
    merged = marked.groupBy("node", "doc_id").agg(F.min("s").alias("start"), (F.max("e") - F.min("s")).alias("words"), F.min("kept").alias("kept"))
    placed = workspace.save(merged.join(components, "node"), "placed")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "component").select("doc_id", "start", "words", "kept", "component_id")


def remove_passages(docs: DataFrame, matches: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the passages that ``matches`` found in smaller ids cut out of ``text``; no row is dropped."""
    owner, spans = one_of(docs.columns, "owner"), one_of(docs.columns, "spans")
    gone = matches.groupBy(F.col("a").alias(owner)).agg(F.collect_set(F.struct("a_start", "words")).alias(spans))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for whole, found in zip(texts, lists, strict=True):
            if found is None or whole is None:
                out.append(whole)
                continue
            raw = whole.encode()
            places = [m.span() for m in WORD.finditer(raw)]
            keep, at = [], 0
            for start, words in sorted((int(f["a_start"]), int(f["words"])) for f in found):
                begin, end = places[min(start, len(places) - 1)][0], places[min(start + words, len(places)) - 1][1]
                if begin > at:
                    keep.append(raw[at:begin])
                at = max(at, end)
            keep.append(raw[at:])
            out.append(b"".join(keep).decode())
        return pd.Series(out, dtype=object)

    joined = docs.join(gone, docs[doc_id] == gone[owner], "left")
    # texts without a passage don't go to Python
    some = F.col(spans).isNotNull()
    return joined.withColumn(text, F.when(some, cut(F.when(some, F.col(text)), F.col(spans))).otherwise(F.col(text))).select(*docs.columns)


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    workspace = Workspace(spark, "passages")
    return clustered(find_matches(docs, workspace), workspace)
