"""WARC archives and a two-level capture index.

``write_archive`` writes one archive per partition (every record a gzip member of its own) and returns where each
capture lies. ``write_index`` sorts these rows by a reversed-host key (``com,example)/path`` and the capture's number),
deals them out by ranges of that key, and writes for each range

* ``.cdx``: the index lines in key order, in compressed blocks of ``BLOCK`` lines, and
* ``.idx``: the sparse directory, one line per block with its first key, offset and length.

The table it returns has one row per range: its files, first key and counts. ``read_captures`` looks captures up: a
binary search over the ranges' first keys, one over the directory of the range found, a range read of that block, a
binary search in it, and a range read of the record. Queries come in key order, so blocks are read once. Payloads cross
the network once, on their way to the archive; only index rows are sorted.

Files go through ``pyarrow.fs`` to the shared folder, under a temporary name that is renamed at the end, and a final one
that holds the task's attempt: a task that is run again, or twice at once, leaves another file, and the saved rows name the
file of the attempt that they come from. The table of ranges is saved before anything is read back.

Defined results: a null payload is empty, a null or unparsable URL gets the key of its text as it stands (null: empty);
repeated rows are captures each of their own; of equal payloads of at least ``min_bytes``, the row with the largest
capture number (all such rows, if repeated; rows without a number count lowest) is the response and the others are
revisits. Extra columns are not carried. An empty table makes no files and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.runtime import Workspace, ship_package

BLOCK = 500
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
CAPTURES = "key string, number long, refers_to long, warc string, offset long, length long"
RANGES = "range int, cdx string, idx string, first_key string, captures long"


def surt(url: Column) -> Column:
    """Reversed-host form of a URL: scheme, user and port go, the host is lowered and reversed."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([\s\S]*)$"
    host, rest = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    reversed_host = F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ",")
    form = F.when(host != "", F.concat(reversed_host, F.lit(")"), F.when(rest == "", "/").otherwise(rest))).otherwise(url)
    return F.regexp_replace(F.coalesce(form, F.lit("")), r"[\x00-\x20\x7f]", "%20")


def capture_key(url: Column, number: Column) -> Column:
    """Sort key of a capture: 20 digits that order as the number does; no number sorts first."""
    shifted = (number.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string")
    return F.concat(surt(url), F.lit(" "), F.coalesce(F.lpad(shifted, 20, "0"), F.lit("-")))


def _qualified(spark: SparkSession, path: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub(r"^file:/+", "file:///", full)


def _partitions(spark: SparkSession) -> int:
    """A stated number, so that AQE doesn't fold the short rows of the index into one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _record_id(number: int | None, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{number}' if number is not None else key)}>"


def record(number: int | None, key: str, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit (``payload`` None) keeps the response's header, whose Content-Length is that of the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_record_id(number, key)}", f"WARC-Date: {DATE}"]
    head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", "%20", url or ""))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        head += [f"WARC-Refers-To: {_record_id(refers_to, key)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names), ``payload`` and ``payload_bytes`` of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    return fields | {"payload": payload, "payload_bytes": size}


def _gz(data: bytes) -> bytes:
    tool = zlib.compressobj(6, zlib.DEFLATED, 31)
    return tool.compress(data) + tool.flush()


class _Files:
    """Files of one task under temporary names, which ``commit`` makes final."""

    def __init__(self, root: str, suffixes: list[str]) -> None:
        from pyspark import TaskContext

        context = TaskContext.get()
        self.part = context.partitionId()
        self.store, base = _store(root)
        self.store.create_dir(base, recursive=True)
        # the attempt is in the name: rows may come in another order to another attempt, and offsets hold for one file only
        self.final = {x: f"{base}/part-{self.part:06d}-{context.taskAttemptId()}.{x}" for x in suffixes}
        self.temporary = {x: f"{p}.tmp" for x, p in self.final.items()}
        self.streams = {x: self.store.open_output_stream(p) for x, p in self.temporary.items()}
        self.at = dict.fromkeys(suffixes, 0)

    def write(self, suffix: str, data: bytes) -> tuple[int, int]:
        self.streams[suffix].write(data)
        self.at[suffix] += len(data)
        return self.at[suffix] - len(data), len(data)

    def commit(self) -> None:
        for x, stream in self.streams.items():
            stream.close()
            self.store.move(self.temporary[x], self.final[x])


def write_archive(captures: DataFrame, workspace: Workspace) -> DataFrame:
    """``captures``: number long, url, key, payload binary (null for a revisit), size long, digest (hex), refers_to long."""
    spark = captures.sparkSession
    ship_package(spark)
    root = _qualified(spark, workspace.path("archive"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: _Files | None = None
        for batch in batches:
            offsets, lengths = [], []
            for row in batch.to_pylist():
                files = files or _Files(root, ["warc.gz"])
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                offset, length = files.write("warc.gz", _gz(record(row["number"], row["key"], row["url"], row["payload"], row["size"], digest, row["refers_to"])))
                offsets.append(offset)
                lengths.append(length)
            if files:
                name = pa.array([files.final["warc.gz"]] * len(offsets), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("number"), batch.column("refers_to"), name, pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "number", "refers_to", "warc", "offset", "length"])
        if files:
            files.commit()

    return workspace.save(captures.select("number", "url", "key", "payload", "size", "digest", "refers_to").mapInArrow(run, CAPTURES), "captures")


def write_index(captures: DataFrame, workspace: Workspace, block: int = BLOCK) -> DataFrame:
    """``captures``: what ``write_archive`` returns."""
    spark = captures.sparkSession
    root = _qualified(spark, workspace.path("index"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: _Files | None = None
        lines: list[str] = []
        count, first = 0, ""

        def close_block() -> None:
            offset, length = files.write("cdx", _gz("".join(lines).encode()))
            files.write("idx", f"{lines[0].rsplit(' {', 1)[0]}\t{offset}\t{length}\n".encode())
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if files is None:
                    files, first = _Files(root, ["cdx", "idx"]), row["key"]
                about = {"n": row["number"], "r": row["refers_to"], "f": row["warc"], "o": row["offset"], "l": row["length"]}
                lines.append(f"{row['key']} {json.dumps(about)}\n")
                count += 1
                if len(lines) == block:
                    close_block()
        if files:
            if lines:
                close_block()
            files.commit()
            yield pa.RecordBatch.from_pydict({"range": [files.part], "cdx": [files.final["cdx"]], "idx": [files.final["idx"]], "first_key": [first], "captures": [count]}, schema=pa.schema([("range", pa.int32()), ("cdx", pa.string()), ("idx", pa.string()), ("first_key", pa.string()), ("captures", pa.int64())]))

    dealt = captures.repartitionByRange(_partitions(spark), "key").sortWithinPartitions("key")
    return workspace.save(dealt.mapInArrow(run, RANGES), "ranges")


class IndexReader:
    """Looks keys up in the ranges of one index; keeps the directory and block it used last, and ``OPEN`` open archives."""

    OPEN = 32

    def __init__(self, root: str, ranges: list[tuple[str, str, str]]) -> None:
        self.store, _ = _store(root)
        self.ranges = sorted(ranges)
        self.firsts = [r[0] for r in self.ranges]
        self._directory: tuple[int, list] = (-1, [])
        self._block: tuple[tuple[int, int], list, list] | None = None
        self._archives: dict = {}

    def _read(self, path: str, offset: int = 0, length: int | None = None) -> bytes:
        with self.store.open_input_file(path) as file:
            if length is None:
                return file.readall()
            return file.read_at(length, offset)

    def _record(self, about: dict) -> bytes:
        file = self._archives.pop(about["f"], None) or self.store.open_input_file(about["f"])
        self._archives[about["f"]] = file  # the last one used stands last
        if len(self._archives) > self.OPEN:
            self._archives.pop(next(iter(self._archives))).close()
        return gzip.decompress(file.read_at(about["l"], about["o"]))

    def find(self, key: str) -> Iterator[tuple[dict, bytes]]:
        """What the index says of each capture with this key, and its record."""
        number = max(0, bisect_right(self.firsts, key) - 1)
        # equal keys (repeated rows) may start in an earlier range or block
        while number and self.firsts[number] == key:
            number -= 1
        while number < len(self.ranges) and self.firsts[number] <= key:
            yield from self._in_range(number, key)
            number += 1

    def _in_range(self, number: int, key: str) -> Iterator[tuple[dict, bytes]]:
        if self._directory[0] != number:
            entries = [line.split("\t") for line in self._read(self.ranges[number][2]).decode().splitlines()]
            self._directory = (number, [(first, int(offset), int(length)) for first, offset, length in entries])
        blocks = self._directory[1]
        at = max(0, bisect_right(blocks, key, key=lambda b: b[0]) - 1)
        while at and blocks[at][0] == key:
            at -= 1
        while at < len(blocks) and blocks[at][0] <= key:
            yield from self._in_block(number, at, blocks[at], key)
            at += 1

    def _in_block(self, number: int, at: int, entry: tuple[str, int, int], key: str) -> Iterator[tuple[dict, bytes]]:
        if self._block is None or self._block[0] != (number, at):
            text = gzip.decompress(self._read(self.ranges[number][1], entry[1], entry[2])).decode()
            pairs = [line.rsplit(" {", 1) for line in text.splitlines()]
            self._block = ((number, at), [k for k, _ in pairs], [json.loads("{" + about) for _, about in pairs])
        _, keys, abouts = self._block
        place = bisect_right(keys, key) - 1
        while place >= 0 and keys[place] == key:
            yield abouts[place], self._record(abouts[place])
            place -= 1


def read_captures(queries: DataFrame, ranges: DataFrame, workspace: Workspace) -> DataFrame:
    """For each distinct ``key`` in ``queries``, the captures: number, payload_bytes, payload_digest, record_type, refers_to.

    The driver holds one short row for each range, that is, for each partition of the archive.
    """
    spark = queries.sparkSession
    root = _qualified(spark, workspace.path("index"))
    known = [tuple(r) for r in ranges.select("first_key", "cdx", "idx").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(root, known)
        for batch in batches:
            out: dict[str, list] = {"number": [], "payload_bytes": [], "payload_digest": [], "record_type": [], "refers_to": []}
            for key in batch.column("key").to_pylist():
                for about, raw in reader.find(key):
                    got = parse_record(raw)
                    stated = got["warc-payload-digest"].removeprefix("sha1:")
                    kind = got["warc-type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(got["payload"]).digest()).decode() != stated:
                        raise ValueError(f"the payload of {key} doesn't have the digest that its record states")
                    for name, value in (("number", about["n"]), ("payload_bytes", got["payload_bytes"]), ("payload_digest", stated), ("record_type", kind), ("refers_to", about["r"] if kind == "revisit" else None)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("number", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    keys = queries.select("key").distinct().repartitionByRange(_partitions(spark), "key").sortWithinPartitions("key")
    return keys.mapInArrow(run, "number long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def plan_captures(pages: DataFrame, number: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """What ``write_archive`` takes, with responses and revisits told apart."""
    slim = pages.select(F.col(number).cast("long").alias("number"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    slim = slim.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    # counts and maxima are combined before the shuffle; the join's hot digest is split by AQE
    copies = slim.where(F.col("size") >= min_bytes).select("digest", "number").groupBy("digest").agg(F.max("number").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = slim.join(copies.select("digest", "winner"), "digest", "left")
    revisit = F.coalesce(F.col("winner").isNotNull() & ~F.col("number").eqNullSafe(F.col("winner")), F.lit(False))
    return joined.select("number", "url", capture_key(F.col("url"), F.col("number")).alias("key"), F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest", F.when(revisit, F.col("winner")).alias("refers_to"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    workspace = Workspace(spark, "warc")
    ranges = write_index(write_archive(plan_captures(pages), workspace), workspace)
    queries = pages.select(capture_key(F.col("url"), F.col("page_id")).alias("key"))
    return read_captures(queries, ranges, workspace).withColumnRenamed("number", "page_id")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS winner FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(hex, CAST(i // 8 AS INT) * 10 + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) + 1 AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM w
"""
