"""Packing of token sequences by the sum-of-squares rule.

Documents become token ids and a closing id 0; only what is longer than a sequence is cut, into full pieces and a last
shorter one. Full pieces are a sequence each. The others are dealt by a hash into shards of about ``SHARD`` pieces, so
that no task grows with the input, and each shard is packed by one pass of the rule: with N(g) open sequences of gap g,
a piece of length s goes where the sum of the N(g)^2 becomes least, that is, where N(g - s) - N(g) is least over the
gaps g >= s that are open, or into a new sequence if that is better still. A shard takes its pieces from the longest on,
dissolves the sequences that stay open and packs their pieces once more; what is still open goes to the next level with
that of other shards, until one shard is left or a level leaves more than ``LEFT`` of its pieces open: pieces that
cannot fill a sequence fill none at a later level either, so the sequences that this level has open stay as they are.

Defined results: a null or empty text is the one id 0; repeated rows are packed each on their own; extra columns are
not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.runtime import Workspace, one_of, ship_package

CAPACITY = 2048
#: Pieces of a shard on the average.
SHARD = 40_000
#: A level that leaves more than this share of its pieces open is the last.
LEFT = 0.75
#: Chunks whose ids are remembered.
MEMO = 400_000
GROUP_BYTES = 2_000_000


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """For each piece its sequence (from 0) and offset; the final gap of each sequence."""
    n = len(sizes)
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    never = np.int64(1) << 40
    for at, size in enumerate(sizes.tolist()):
        # change of the sum over 2, less 1: N(g - s) - N(g); a gap of 0 isn't counted, so closing gives -N(s) - 1/2
        change = counts[: capacity + 1 - size] - counts[size:]
        change[0] = -counts[size]
        change = np.where(counts[size:] > 0, 2 * change + 2, never)
        if counts[size]:
            change[0] -= 1
        new = 2 * counts[capacity - size] + 1 if size < capacity else 0
        best = int(change.argmin())
        if change[best] <= new:
            gap = best + size
            counts[gap] -= 1
            mine = open_bins[gap].pop()
        else:
            gap, mine = capacity, len(gaps)
            gaps.append(capacity)
        bins[at], offsets[at] = mine, capacity - gap
        gaps[mine] = gap - size
        if gap > size:
            counts[gap - size] += 1
            open_bins[gap - size].append(mine)
    return bins, offsets, gaps


#: ASCII signs but the apostrophe, between a Latin letter and white space: a token run of their own, whatever stands before.
SIGNS = rb"[!-&(-/:-@\[-`{-~]"
STOP = re.compile(SIGNS + rb"(?:(?<=[a-z].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))" + SIGNS + rb"*(?=[ \n]|\Z)")
#: A word of lower-case Latin letters: one token run, and left as it is by the normaliser.
WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: How byte-level vocabularies write the bytes that aren't printable in Latin-1.
WRITTEN = {b: 256 + n for n, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


def settle(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """``sum_of_squares`` of pieces from the longest on, then once more for those in sequences that stayed open."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    bins[order], offsets[order], gaps = sum_of_squares(sizes[order], capacity)
    left = np.flatnonzero(np.array(gaps, dtype=np.int64)[bins] > 0)
    left = left[np.argsort(-sizes[left], kind="stable")]
    if len(left):
        again, places, gaps2 = sum_of_squares(sizes[left], capacity)
        if len(gaps2) <= sum(g > 0 for g in gaps):
            bins[left], offsets[left] = again + len(gaps), places
            gaps = [g if g == 0 else 0 for g in gaps] + gaps2
    return bins, offsets, gaps


#: Texts that tell whether a vocabulary can be used by chunks.
PROBES = ["The Quick brown", "a  b\n\nc", "word, (word). 'tis it's", "über Straße naïve", " lead and trail ", "x--y a.b. U.S.A."]


class WordTokenizer:
    """Ids by ``tokenizers``; a text's white-space separated chunks have ids of their own, so those of known chunks are kept.

    The vocabulary is lower-case: A-Z are lowered beforehand where no combining mark (lead bytes CC, CD) could have
    composed with one, and signs after a word are set off, so that more chunks are known.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        # another vocabulary may keep upper case, or see white space in its tokens: whole texts are encoded then
        self.by_chunks = True
        whole = [np.array(self._ids(p)).tobytes() for p in PROBES]
        self.by_chunks = self.encode_many([p.encode() for p in PROBES]) == whole
        self.memo.clear()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, fresh: list[bytes]) -> None:
        run = self.tool.model.tokenize
        for chunk in fresh:
            if WORD(chunk):
                self.memo[chunk] = array("I", [token.id for token in run(chunk.decode("latin-1").translate(WRITTEN))]).tobytes()
            else:
                self.memo[chunk] = self._ids(chunk.decode("utf-8")).tobytes()

    @staticmethod
    def _chunks(text: bytes) -> list[bytes]:
        if b"\xcc" in text or b"\xcd" in text or b"<|" in text:
            return text.split()
        return STOP.sub(rb" \g<0>", text.lower()).split()

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_chunks:
            return [self._ids(t.decode("utf-8", "replace")).tobytes() for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        split = [self._chunks(t) for t in texts]
        self._learn(list({c for chunks in split for c in chunks} - self.memo.keys()))
        return [b"".join(map(self.memo.__getitem__, chunks)) for chunks in split]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def grouped(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > GROUP_BYTES:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer(path)
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            at = 0
            for ids in (x for part in grouped([t or b"" for t in batch.column("text").to_pylist()]) for x in tool.encode_many(part)):
                ids += b"\0\0\0\0"
                for number, begin in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[begin : begin + 4 * capacity]
                    owner.append(at)
                    piece.append(number)
                    start.append(begin // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                at += 1
            yield pa.record_batch([batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _shard_packer(capacity: int, level: int, last: bool, left_over: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # pieces in an order that depends on nothing but themselves: a retried task packs alike
        group = group.sort_values([c for c in ("ids_crc32", "doc_id", "piece") if c in group], kind="stable").reset_index(drop=True)
        bins, offsets, gaps = settle(group["length"].to_numpy(), capacity)
        return group.assign(**{"sequence_id": (np.int64(level) << 56) + (np.int64(key[0]) << 28) + bins, "offset": offsets, left_over: (np.array(gaps)[bins] > 0) & (not last)})

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, workspace: Workspace | None = None) -> DataFrame:
    """``rows`` (each with a ``length`` of at most ``capacity``) with sequence_id and offset added."""
    spark = rows.sparkSession
    ship_package(spark)
    workspace = workspace or Workspace(spark, "packing")
    rows = workspace.save(rows, "pieces")
    names = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    rows = rows.select(*names)
    in_shard, left_over = one_of(names, "shard"), one_of(names, "left_over")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, `{in_shard}` int, `sequence_id` long, `offset` long, `{left_over}` boolean"
    done: DataFrame | None = None
    level, count = 0, rows.count()
    while count:
        shards = max(1, round(count / shard))
        last = shards == 1

        order = [c for c in ("doc_id", "piece", "ids_crc32") if c in names] or names
        dealt = rows.withColumn(in_shard, F.pmod(F.xxhash64(F.lit(level), *order), F.lit(shards)).cast("int"))
        packed = workspace.save(dealt.groupBy(in_shard).applyInPandas(_shard_packer(capacity, level, last, left_over), schema), f"level{level}")
        rows = packed.where(F.col(left_over)).select(*names)
        left = rows.count()
        last = last or left > LEFT * count
        good = (packed if last else packed.where(~F.col(left_over))).select(*names, "sequence_id", "offset")
        done = good if done is None else done.unionByName(good)
        if last:
            break
        level, count = level + 1, left
    return done if done is not None else rows.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
