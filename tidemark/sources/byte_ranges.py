"""Files as bytes: ranges of them, and digests of whole files, by a data source that streams.

A digest needs a file's bytes in their order, so a file is one task, which holds a chunk at a time, however large the file is. The
beginning of a file is read as such, not as part of the whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.storage import leaves

CHUNK = 4 << 20
_RANGES = "path string, start long, content binary"
_DIGESTS = "path string, bytes long, sha256 string"


def _open(path: str):
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int

    def __post_init__(self) -> None:
        super().__init__((self.path, self.start, self.end))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files, self.digests = json.loads(options["files"]), options.get("digests") == "true"
        self.range, self.first = int(options.get("range", 64 << 20)), int(options.get("first", 0))

    def partitions(self) -> list[FileRange]:
        if self.digests or self.first:
            return [FileRange(p, 0, min(size, self.first) if self.first else size) for p, size in self.files]
        return [FileRange(p, at, min(size, at + self.range)) for p, size in self.files for at in range(0, max(1, size), self.range)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        digest, at = hashlib.sha256(), partition.start
        with _open(partition.path) as file:
            file.seek(at)
            while at < partition.end and (chunk := file.read(min(CHUNK, partition.end - at))):
                if self.digests:
                    digest.update(chunk)
                else:
                    yield pa.RecordBatch.from_pydict({"path": [partition.path], "start": [at], "content": [chunk]}, pa.schema([("path", pa.string()), ("start", pa.int64()), ("content", pa.binary())]))
                at += len(chunk)
        if self.digests:
            yield pa.RecordBatch.from_pydict({"path": [partition.path], "bytes": [at], "sha256": [digest.hexdigest()]})


class FileBytes(DataSource):
    """``file_bytes``: (path, start, content) of the listed files, in chunks; with ``digests`` (path, bytes, sha256) of each."""

    @classmethod
    def name(cls) -> str:
        return "file_bytes"

    def schema(self) -> str:
        return _DIGESTS if self.options.get("digests") == "true" else _RANGES

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def _read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(FileBytes)
    return spark.read.format("file_bytes").options(files=json.dumps(leaves(spark, path)), **options).load()


def byte_ranges(spark: SparkSession, path: str, size: int = 64 << 20) -> DataFrame:
    """(path, start, content) of the files at a path: a task has a range of ``size`` bytes, a row a chunk of it."""
    return _read(spark, path, range=str(size))


def beginnings(spark: SparkSession, path: str, size: int) -> DataFrame:
    """The same of the first ``size`` bytes of each file alone."""
    return _read(spark, path, first=str(size))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file at a path, of any size. Where only Spark knows the file system, a file is read as one value."""
    found = leaves(spark, path)
    scheme = found[0][0].partition(":")[0] if found else "file"
    try:
        scheme == "file" or fs.FileSystem.from_uri(found[0][0])
    except (pa.ArrowInvalid, OSError):
        return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return _read(spark, path, digests="true")


def digest_of(spark: SparkSession, path: str) -> str:
    """The digest of a file, or of the digests of a folder's files in the order of their names."""
    found = [r["sha256"] for r in checksums(spark, path).orderBy("path").select("sha256").collect()]  # a row a file
    return found[0] if len(found) == 1 else hashlib.sha256("".join(found).encode()).hexdigest()
