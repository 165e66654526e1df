"""SentencePiece encoding and decoding for merge-type vocabularies with byte fallback.

White space becomes U+2581, and a text that isn't empty gets one in front. An agenda (a heap) holds the adjacent pairs of
symbols that the vocabulary knows as one piece, best score first, leftmost among equals. The top pair is joined and
its two new neighbours enter the agenda; entries whose symbols have changed meanwhile are passed over. Characters that no
piece covers become the ids of their bytes.

No merge reaches over a place that no piece spans: before U+2581 after another character (unless a piece does), and between
characters that no chain of pieces connects (letters and signs, say). Texts are cut there, and a bounded memo holds the ids of
segments. Each segment that enters the memo is checked against the sentencepiece library, an Arrow batch's segments at a time.

Defined results: null is the empty text, whose ids are the begin and end id alone; repeated rows are encoded each on their
own; extra columns pass through ``encode_table``; an empty table gives an empty result. Vocabularies of another type, with
a character map, without byte fallback or with unused pieces raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.byte_bpe import groups
from cadastra.runtime import ship_package

SPACE = "▁"
#: Fixed values of the file format: kinds of pieces, and the number of the merge-type model.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
MERGES = 2
#: Segments whose ids are remembered; beyond, the memo starts anew.
MEMO = 1_000_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Pieces:
    """An encoder and decoder for one model file."""

    def __init__(self, path: str, verify: bool = True) -> None:
        with open(path, "rb") as file:
            data = file.read()
        kinds, names, scores = [], [], []
        trainer: dict[int, int | bytes] = {}
        normalizer: dict[int, int | bytes] = {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                names.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if trainer.get(3, 1) != MERGES or trainer.get(24) or normalizer.get(2) or not normalizer.get(5, 1) or not trainer.get(35) or UNUSED in kinds:
            raise ValueError(f"{path}: not a merge-type vocabulary with byte fallback and texts as they stand")
        self.prefix, self.squeeze = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        self.ids = {name: i for i, (name, kind) in enumerate(zip(names, kinds, strict=True)) if kind in (NORMAL, USER_DEFINED)}
        order = {score: rank for rank, score in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.ranks = {name: order[scores[i]] for name, i in self.ids.items()}
        self.coded = {name: i.to_bytes(4, "little") for name, i in self.ids.items()}
        self.fixed = {name for name, i in self.ids.items() if kinds[i] == USER_DEFINED}
        byte_ids = {int(name[3:5], 16): i for i, (name, kind) in enumerate(zip(names, kinds, strict=True)) if kind == BYTE}
        self.byte_ids = [byte_ids[b].to_bytes(4, "little") for b in range(256)]
        self.begin, self.end = (np.array([names.index(mark)], dtype="<u4").tobytes() for mark in (trainer.get(46, b"<s>").decode(), trainer.get(47, b"</s>").decode()))
        plain = {CONTROL: lambda i: b"", UNKNOWN: lambda i: trainer.get(44, " ⁇ ".encode()), BYTE: lambda i: bytes([int(names[i][3:5], 16)])}
        self.tokens = [plain.get(kind, lambda i: names[i].replace(SPACE, " ").encode())(i) for i, kind in enumerate(kinds)]
        self.control = np.array([kind == CONTROL for kind in kinds])
        self.leads = [kinds[i] in (NORMAL, USER_DEFINED) and name.startswith(SPACE) for i, name in enumerate(names)]
        self.find = re.compile(self._segments()).findall
        self.memo: dict[str, bytes] = {}
        self.library = None
        if verify:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def _segments(self) -> str:
        """Cuts a text only where no piece spans the cut: characters that follow one another in a piece are of one kin."""
        longer = [name for name in self.ids if len(name) > 1 and name not in self.fixed]
        whole = [re.escape(name) for name in sorted(self.fixed, key=len, reverse=True)]
        if any(SPACE in name.lstrip(SPACE) for name in longer) or whole:
            # user-defined pieces may begin anywhere: what lies between them stays whole
            rest = f"(?:(?!{'|'.join(whole)}).)+" if whole else ".+"
            return f"(?s:{'|'.join([*whole, rest])})"
        kin: dict[str, set[str]] = {}
        for name in longer:
            merged: set[str] = set()
            for c in set(name) - {SPACE}:
                merged |= kin.get(c, {c})
            kin |= dict.fromkeys(merged, merged)
        classes = ["".join(map(re.escape, sorted(c))) for c in sorted({id(c): c for c in kin.values()}.values(), key=len, reverse=True)]
        return f"{SPACE}*(?:{'|'.join(f'[{c}]+' for c in classes)})|{SPACE}+|[^{SPACE}]"

    def merge(self, segment: str) -> bytes:
        """Ids of one segment, by the agenda. An entry is one number: rank of the score, place of the left symbol, end of the right one."""
        ranks, size = self.ranks, len(segment)
        if segment in self.fixed:
            return self.coded[segment]
        bits = size.bit_length()
        twice, mask = 2 * bits, (1 << bits) - 1
        end = list(range(1, size + 1)) + [0]  # of the symbol that begins here; 0: none does any more
        before = list(range(-1, size))
        agenda = [ranks[pair] << twice | i << bits | i + 2 for i in range(size - 1) if (pair := segment[i : i + 2]) in ranks]
        heapify(agenda)
        while agenda:
            top = heappop(agenda)
            left, stop = top >> bits & mask, top & mask
            right = end[left]
            if not right or end[right] != stop:
                continue
            end[left], end[right] = stop, 0
            before[stop] = left
            if stop < size and (pair := segment[left : end[stop]]) in ranks:
                heappush(agenda, ranks[pair] << twice | left << bits | end[stop])
            if (prior := before[left]) >= 0 and (pair := segment[prior:stop]) in ranks:
                heappush(agenda, ranks[pair] << twice | prior << bits | stop)
        coded = self.coded
        out, at = [], 0
        while at < size:
            symbol = segment[at : end[at]]
            out.append(coded.get(symbol) or self._bytes(symbol))
            at = end[at]
        return b"".join(out)

    def _bytes(self, symbol: str) -> bytes:
        return b"".join(self.byte_ids[b] for b in symbol.encode("utf-8", "replace"))

    def check(self, segments: list[str], merged: list[bytes]) -> None:
        """The library's ids of each segment must be the same. A line feed before a segment keeps the dummy prefix off it."""
        if self.library is None or self.fixed or not self.prefix or self.squeeze:
            return
        spaced = [len(s) > 1 and s[0] == SPACE for s in segments]
        found = self.library.encode([s[1:] if led else f"\n{s}" for s, led in zip(segments, spaced, strict=True)], num_threads=1)
        for segment, led, ids, mine in zip(segments, spaced, found, merged, strict=True):
            if np.array(ids if led else ids[2:], dtype="<u4").tobytes() != mine:
                raise ValueError(f"the library encodes {segment!r} otherwise")

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text without marks, as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, split = self.memo, []
        for text in texts:
            if self.squeeze:
                text = re.sub(" +", " ", text.strip(" "))
            text = text.replace(" ", SPACE)
            split.append(self.find(SPACE + text if self.prefix and text else text))
        fresh = [s for s in {s for segments in split for s in segments} if s not in memo]
        merged = [self.merge(s) for s in fresh]
        self.check(fresh, merged)
        memo.update(zip(fresh, merged, strict=True))
        return [b"".join(map(memo.__getitem__, segments)) for segments in split]

    def encode(self, text: str, marks: bool = True) -> bytes:
        ids = self.encode_many([text])[0]
        return self.begin + ids + self.end if marks else ids

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4")
        marks = np.flatnonzero(self.control[numbers])
        # bytes on both sides of a mark never make up one character
        data = [b"".join(map(self.tokens.__getitem__, part.tolist())) for part in np.split(numbers, marks)]
        if self.prefix or self.squeeze:
            # the first piece with a text loses the space in front
            first = next((i for i in numbers.tolist() if self.tokens[i]), None)
            if first is not None and self.leads[first]:
                k = next(k for k, part in enumerate(data) if part)
                data[k] = data[k].lstrip(b" ") if self.squeeze else data[k][1:]
        # bytes that are no UTF-8 come out as one replacement character each
        return re.sub("[\udc80-\udcff]", "\ufffd", "".join(part.decode("utf-8", "surrogateescape") for part in data))


@lru_cache(maxsize=2)
def pieces(path: str, verify: bool = True) -> Pieces:
    return Pieces(path, verify)


def encode_table(df: DataFrame, path: str, text: str = "text", ids: str = "ids", marks: bool = True) -> DataFrame:
    """``df`` with a binary column ``ids`` (little-endian unsigned 32-bit); ``marks`` puts the begin and end id around them."""
    ship_package(df.sparkSession)

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        tool = pieces(path)
        found = [ids for part in groups([t or "" for t in texts]) for ids in tool.encode_many(part)]
        return pd.Series([tool.begin + ids + tool.end if marks else ids for ids in found], dtype=object)

    return df.withColumn(ids, encode(F.coalesce(F.col(text), F.lit(""))))


def decode_table(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with a string column ``out``: the text that ``ids`` stand for; null ids are no ids."""
    ship_package(df.sparkSession)

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        tool = pieces(path)
        return rows.map(lambda b: tool.decode(b or b""))

    return df.withColumn(out, decode(F.coalesce(F.col(ids), F.lit(b""))))


def digest_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded texts never leave the task that made them."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pieces(path)
        for batch in batches:
            counts, coded, plain = [], [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for found in (x for part in groups(texts) for x in tool.encode_many(part)):
                ids = tool.begin + found + tool.end
                counts.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                plain.append(hashlib.sha256(tool.decode(ids).encode()).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest_table(docs, public_tokenizers.path("piece_bpe_32k.model"))
