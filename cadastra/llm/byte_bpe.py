"""Byte-level BPE encoding and decoding with a segment tree for the merges.

Each match of the pattern is a row of bytes. A segment tree over the byte positions holds, at a live position, the rank
of the pair that starts there; every inner node holds the leftmost least rank below it. A merge takes the root, joins
the pair, and updates the two live neighbours in O(log n), so that a match of n bytes costs O(n log n) even where one
match is a megabyte long.

Equal runs of "white space, then other characters" always have equal ids, since no match of the pattern reaches over
the start of a white-space run; encoders keep a bounded memo of them.

Defined results: null is the empty text, which has no ids; repeated rows are encoded each on their own; extra columns
pass through ``encode_table``; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.runtime import ship_package

#: White_Space of Unicode, which \s of the pattern means.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NONE = 1 << 60
#: Runs whose ids are remembered; beyond, the memo starts anew.
MEMO = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class PairTree:
    """Leftmost minimum over positions; ``update`` and ``least`` take O(log n) and O(1)."""

    def __init__(self, values: list[int]) -> None:
        self.size = 1 << max(0, (len(values) - 1).bit_length())
        # (rank, position) as one number: the least is the lowest rank, leftmost among equals
        self.node = [NONE] * self.size + [v << 32 | i if v < NONE else NONE for i, v in enumerate(values)] + [NONE] * (self.size - len(values))
        for i in range(self.size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def update(self, position: int, value: int) -> None:
        node, i = self.node, self.size + position
        node[i] = value << 32 | position if value < NONE else NONE
        i >>= 1
        while i:
            left, right = node[2 * i], node[2 * i + 1]
            best = left if left <= right else right
            if node[i] == best:
                break
            node[i] = best
            i >>= 1

    def least(self) -> int:
        return self.node[1]


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    tree = PairTree([ranks.get(piece[i : i + 2], NONE) for i in range(n - 1)])
    while (least := tree.least()) < NONE:
        i = least & 0xFFFFFFFF
        j = after[i]
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
        if j < n - 1:
            tree.update(j, NONE)
        tree.update(i, ranks.get(piece[i : after[k]], NONE) if k < n else NONE)
        if (p := before[i]) >= 0:
            tree.update(p, ranks.get(piece[p : after[i]], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class PairRanks:
    """Rank of a pair of token ids, in an open-addressing table that arrays of pairs are looked up in."""

    BITS = 21

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = [(ranks[t[:s]] << 32 | ranks[t[s:]], rank) for t, rank in ranks.items() for s in range(1, len(t)) if t[:s] in ranks and t[s:] in ranks]
        self.keys = np.full(1 << self.BITS, -1, dtype=np.int64)
        self.values = np.full(1 << self.BITS, NONE, dtype=np.int64)
        for key, rank in pairs:
            slot = int(self._slot(np.array([key], dtype=np.int64))[0])
            while self.keys[slot] != -1:
                slot = (slot + 1) & ((1 << self.BITS) - 1)
            self.keys[slot], self.values[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], NONE)
        again = np.flatnonzero((held != keys) & (held != -1))
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self.BITS) - 1)
            held = self.keys[slot[again]]
            hit = held == keys[again]
            out[again[hit]] = self.values[slot[again[hit]]]
            again = again[~hit & (held != -1)]
        return out


class ByteBpe:
    """An encoder and decoder for one rank file and pattern."""

    #: Longest match that is merged beside others of its length in one array of trees.
    WIDEST = 64

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks = load_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pairs = PairRanks(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.find = regex.compile(pattern).findall
        self.runs = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.memo: dict[str, bytes] = {}

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """``merge_piece`` for many matches of up to ``width`` bytes, a tree in each row of one array."""
        count, rows = len(pieces), np.arange(len(pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(count, width)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=count)
        places = np.arange(width)
        ids = np.zeros((count, width + 1), dtype=np.int64)
        ids[:, :width] = self.byte_ids[raw]
        after = np.tile(np.arange(1, width + 2), (count, 1))
        before = np.tile(np.arange(-1, width + 1), (count, 1))
        alive = places < sizes[:, None]
        first = np.where(places < sizes[:, None] - 1, self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, width), NONE)
        tree = np.full((count, 2 * width), NONE, dtype=np.int64)
        tree[:, width:] = np.where(first < NONE, first << 8 | places, NONE)
        for level in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * level], tree[:, 2 * level + 1], out=tree[:, level])

        def put(at: np.ndarray, place: np.ndarray, rank: np.ndarray) -> None:
            node = place + width
            tree[at, node] = np.where(rank < NONE, rank << 8 | place, NONE)
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[at, node] = np.minimum(tree[at, 2 * node], tree[at, 2 * node + 1])

        while len(rows := rows[tree[rows, 1] < NONE]):
            least = tree[rows, 1]
            i, rank = least & 255, least >> 8
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i] = rank
            after[rows, i] = k
            before[rows, k] = i
            alive[rows, j] = False
            put(rows, j, np.full(len(rows), NONE))
            put(rows, i, np.where(k < sizes[rows], self.pairs.get(rank, ids[rows, k]), NONE))
            has = before[rows, i] >= 0
            at, p = rows[has], before[rows[has], i[has]]
            put(at, p, self.pairs.get(ids[at, p], rank[has]))
        flat = ids[:, :width][alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each distinct match."""
        found: dict[bytes, bytes] = {}
        classes: dict[int, list[bytes]] = {}
        for piece in pieces:
            if piece in self.ranks:
                found[piece] = self.ranks[piece].to_bytes(4, "little")
            elif len(piece) <= self.WIDEST:
                classes.setdefault(max(8, 1 << (len(piece) - 1).bit_length()), []).append(piece)
            else:
                found[piece] = np.array(merge_piece(piece, self.ranks), dtype="<u4").tobytes()
        for width, group in classes.items():
            for start in range(0, len(group), 8192):
                part = group[start : start + 8192]
                found.update(zip(part, self._merge_rows(part, width), strict=True))
        return found

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, split = self.memo, [self.runs(t) for t in texts]
        fresh = list({run for runs in split for run in runs} - memo.keys())
        cut = [[p.encode("utf-8", "surrogatepass") for p in self.find(run)] for run in fresh]
        merged = self.merge(list({p for pieces in cut for p in pieces}))
        memo.update((run, b"".join(map(merged.__getitem__, pieces))) for run, pieces in zip(fresh, cut, strict=True))
        return [b"".join(map(memo.__getitem__, runs)) for runs in split]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


#: Characters of the texts that are encoded together.
GROUP_CHARS = 2_000_000


def groups(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for text in texts:
        if part and chars + len(text) > GROUP_CHARS:
            yield part
            part, chars = [], 0
        part.append(text)
        chars += len(text)
    if part:
        yield part


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_table(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a binary column ``ids`` (little-endian unsigned 32-bit)."""
    ship_package(df.sparkSession)

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        tool = encoder(path, pattern)
        return pd.Series([ids for part in groups([t or "" for t in texts]) for ids in tool.encode_many(part)], dtype=object)

    return df.withColumn(ids, encode(F.coalesce(F.col(text), F.lit(""))))


def decode_table(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with a binary column ``out``: the bytes that ``ids`` stand for; null ids are no ids."""
    ship_package(df.sparkSession)

    @F.pandas_udf("binary")
    def decode(rows: pd.Series) -> pd.Series:
        tool = encoder(path, pattern)
        return rows.map(lambda b: tool.decode(b or b""))

    return df.withColumn(out, decode(F.coalesce(F.col(ids), F.lit(b""))))


def digest_table(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded bytes never leave the task that made them."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in batches:
            counts, coded, plain = [], [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for ids in (x for part in groups(texts) for x in tool.encode_many(part)):
                counts.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                plain.append(hashlib.sha256(tool.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest_table(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
