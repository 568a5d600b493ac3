"""WARC records in seekable Zstandard bundles.

Each partition writes bundles of independent frames, a few hundred kilobytes of records each, and after the frames the
format's seek table in a skippable frame, so any Zstandard tool reads the bundle and a reader with the table opens any
frame alone. The index maps a record's identifier to its bundle, frame, and place inside the frame. It is a table that
Spark commits: bundles of lost or repeated tasks are in no index.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import files
from tidemark.llm.common import arrow_batches, col, join_checked, materialize, scratch_path

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 512 << 20
LEVEL = 3

# The seekable format's magic numbers and the profile of revisits.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

_INDEX = "record_id string, page_id {id}, path string, frame int, offset long, length long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, revisit_of: int | None, is_revisit: bool) -> bytes:
    """One record; a revisit's block is the HTTP head alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(revisit_of)}"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class BundleWriter:
    """Frames and, at the end, their seek table."""

    def __init__(self, path: str, level: int = LEVEL) -> None:
        self.path, self.out = path, files.create(path)
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.held: list[bytes] = []
        self.size = self.written = 0
        self.table: list[tuple[int, int]] = []

    def add(self, record: bytes, frame_bytes: int = FRAME_BYTES) -> tuple[int, int, int]:
        """The record's frame, its offset there, and its length."""
        if self.size and self.size + len(record) > frame_bytes:
            self.flush()
        place = len(self.table), self.size, len(record)
        self.held.append(record)
        self.size += len(record)
        return place

    def flush(self) -> None:
        frame = self.compress(b"".join(self.held))
        self.out.write(frame)
        self.table.append((len(frame), self.size))
        self.written += len(frame)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self.flush()
        entries = b"".join(struct.pack("<II", *e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class BundleReader:
    """Any frame of a bundle by its number."""

    def __init__(self, path: str) -> None:
        system, at = files.at(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        width = 12 if flags & 0x80 else 8
        table = self.file.read_at(count * width, size - 9 - count * width)
        self.frames, start = [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", table, i * width)
            self.frames.append((start, packed, plain))
            start += packed
        self.now: tuple[int, bytes] = (-1, b"")

    def frame(self, number: int) -> bytes:
        if self.now[0] != number:
            start, packed, plain = self.frames[number]
            self.now = number, zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, start), max_output_size=plain)
        return self.now[1]


def parse(record: bytes | memoryview) -> tuple[dict[str, str], int, bytes]:
    """Headers by lower-case name, the payload's declared size, and the payload (empty in a revisit)."""
    record = bytes(record)
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, size, payload


def _id_of(reference: str) -> int | None:
    value = reference.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "None" else int(value)


def mark_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, size, digest, original, revisit) of every page.

    Pages with equal payloads of at least ``least`` bytes share ``original``, their largest page_id. Digests of pages are
    counted by a partial aggregate, so a group of any size is one row; only groups of two or more are joined back.
    A null html is an empty payload and no revisit; pages of any length are digested whole; of repeated rows all have the same original. An
    empty table gives no rows; columns beside page_id, url and html are not read.
    """
    bare = pages.select(
        col("page_id").alias("page_id"), col("url").cast("string").alias("url"), F.coalesce(col("html").cast("binary"), F.lit(b"")).alias("payload"))
    hashed = bare.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    groups = hashed.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.where("n > 1 and original is not null").drop("n"), "equal-payloads")
    joined = join_checked(hashed, groups, ["digest", "size"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select("page_id", "url", "payload", "size", "digest", "original", revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record a page into bundles in ``folder`` (one in the shared folder if None); returns the index.

    A null html is an empty payload, a null url leaves out the target. Repeated rows get a record each; of rows with the
    largest page_id of a group all are responses. A very long page is a record, and a frame, of its own. An empty table writes nothing;
    other columns are not read.
    """
    spark = pages.sparkSession
    arrow_batches(spark)
    folder = folder or scratch_path(spark, "warc")
    marked = mark_revisits(pages, least)
    schema = _INDEX.format(id=marked.schema["page_id"].dataType.simpleString())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, made, bundle = f"{folder}/{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}", 0, None
        for batch in batches:
            found = []
            for page, url, payload, size, digest, original, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    bundle = BundleWriter(f"{name}-{made}.warc.zst")
                    made += 1
                place = bundle.add(_record(page, url, payload, digest, size, original, revisit), frame_bytes)
                found.append((record_id(page), page, bundle.path, *place))
                if bundle.written > bundle_bytes:
                    bundle.close()
                    bundle = None
            if found:
                kinds = (pa.string(), batch.schema.field(0).type, pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["record_id", "page_id", "path", "frame", "offset", "length"])
        if bundle:
            bundle.close()

    return materialize(marked.mapInArrow(write, schema), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """(page_id, record_type, refers_to, declared_bytes, declared_digest, payload) of the records in ``index``.

    Any part of an index will do, an empty one gives no rows, a repeated row its record again, and columns that the index doesn't have are not
    read. Rows come from its files in the order of writing, so a frame is opened once; it is decompressed whole, a very long record with it.
    """
    kind = index.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = lru_cache(maxsize=2)(BundleReader)
        for batch in batches:
            rows = []
            for identifier, page, path, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                headers, size, payload = parse(reader(path).frame(frame)[offset : offset + length])
                if headers["warc-record-id"] != identifier:
                    raise ValueError(f"{path} has {headers['warc-record-id']} where {identifier} should be")
                revisit = headers["warc-type"] == "revisit"
                rows.append((page, headers["warc-type"], _id_of(headers["warc-refers-to"]) if revisit else None, size, headers["warc-payload-digest"].removeprefix("sha1:"), None if revisit else payload))
            if rows:
                id_type = batch.schema.field(1).type
                kinds = (id_type, pa.string(), id_type, pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "record_type", "refers_to", "declared_bytes", "declared_digest", "payload"])

    ordered = index.select("record_id", "page_id", "path", "frame", "offset", "length")
    return ordered.mapInArrow(read, f"page_id {kind}, record_type string, refers_to {kind}, declared_bytes long, declared_digest string, payload binary")


def digests(pages: DataFrame) -> DataFrame:
    """What the archives hold, read back: sizes and digests come from the payloads, in a revisit from its head."""
    back = read_archives(write_archives(pages))
    return back.select(
        "page_id", F.coalesce(F.octet_length("payload").cast("long"), F.col("declared_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("declared_digest")).alias("payload_digest"), "record_type", "refers_to")


#: The same rows in DuckDB.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
o AS (SELECT html, max(page_id) AS original FROM p WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY html)
SELECT p.page_id, p.payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN o.original <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o.original <> p.page_id THEN o.original END AS refers_to
FROM p LEFT JOIN o ON o.html = p.html
"""
