"""Token ids in flat binary files.

A data set is a list of parts in ascending document id. A part is three files of little-endian numbers: ``.bin`` the ids
of its documents one after another, unsigned and of 16 bits if the vocabulary allows, else 32; ``.idx`` 64-bit offsets of
its documents in the whole data set, one more than there are documents; ``.doc`` 64-bit document ids. Parts are written
side by side; where each begins in the data set follows from prefix sums of their sizes, and then the offsets are written.
A list of parts is a table of one row each, committed by Spark: files of lost or repeated tasks are in no list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import files
from tidemark.llm.common import HEAD, arrow_batches, col, materialize, scratch_path, text_parts
from tidemark.llm.tokens import tokenizer

END_ID = 2
#: Bytes of text that a part should hold, on average.
PART_BYTES = 64 << 20
#: Stands for a null document id.
NO_ID = -(1 << 63)

_PARTS = "part long, path string, dtype string, documents long, tokens long"


class _Part:
    def __init__(self, folder: str, part: int, dtype: str) -> None:
        self.part, self.dtype = part, dtype
        self.path = f"{folder}/{part:08d}-{TaskContext.get().taskAttemptId()}"
        self.out = files.create(self.path + ".bin")
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, docs: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> None:
        self.out.write(tokens.astype(self.dtype).tobytes())
        self.ids.append(docs)
        self.sizes.append(sizes)

    def close(self) -> tuple:
        self.out.close()
        sizes = np.concatenate(self.sizes)
        files.put(self.path + ".doc", np.concatenate(self.ids).astype("<i8").tobytes())
        files.put(self.path + ".len", sizes.astype("<i8").tobytes())
        return self.part, self.path, self.dtype, len(sizes), int(sizes.sum())


def _with_end(ids: np.ndarray, starts: np.ndarray, end_id: int) -> np.ndarray:
    return np.insert(ids, starts[1:], end_id)


def write_token_files(docs: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the data set into ``folder`` (one in the shared folder if None); returns its list of parts with their ``base``.

    Document ids are integers. Nulls sort first and are kept as NO_ID; a null or empty text is ``end_id`` alone; repeated
    rows stand next to each other, by their text. A very long text is one document of one part, written as a batch; an
    empty table has no parts; columns beside the two named are not read.

    Parts are ranges of (id, beginning of the text), so an id that many rows have spreads over parts. Spark samples the
    ranges; a part's number is its partition's.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    folder = folder or scratch_path(spark, "token-files")
    bare = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    parts = text_parts(bare, "text", PART_BYTES)
    dealt = bare.repartitionByRange(parts, F.col("doc_id"), F.coalesce(F.substring("text", 1, HEAD), F.lit(""))).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk, part = tokenizer(path), None
        dtype = "<u2" if max(tk.library.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
        for batch in batches:
            if batch.num_rows:
                part = part or _Part(folder, TaskContext.get().partitionId(), dtype)
                ids, starts = tk.encode(batch.column(1))
                part.add(batch.column(0).fill_null(NO_ID).to_numpy(), _with_end(ids, starts, end_id), np.diff(starts) + 1)
        closed = [part.close()] if part else []
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*closed, strict=True) if closed else [[]] * 5, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "path", "dtype", "documents", "tokens"])

    listed = materialize(dealt.mapInArrow(write, _PARTS), "token-parts")
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    based = listed.withColumn("base", F.coalesce(before, F.lit(0)))

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = files.array(row["path"] + ".len", "<i8")
                files.put(row["path"] + ".idx", (row["base"] + np.concatenate([[0], np.cumsum(sizes)])).astype("<u8").tobytes())
            yield batch

    return materialize(_one_each(based).mapInArrow(offsets, _PARTS + ", base long"), "token-list")


def _one_each(parts: DataFrame) -> DataFrame:
    """Parts dealt one by one over as many tasks as there are shuffle partitions."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartitionById(n, F.pmod(F.col("part"), F.lit(n)).cast("int"))


def read_token_files(parts: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(doc_id, start, ids) of every document of a data set: its first id's place in the data set, and its ids as
    little-endian unsigned 32-bit numbers. Files are memory-mapped; about ``block`` ids are handled at once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, idx = files.array(row["path"] + ".bin", row["dtype"]), files.array(row["path"] + ".idx", "<u8").astype("i8")
                docs = files.array(row["path"] + ".doc", "<i8")
                own = idx - row["base"]
                at = 0
                while at < len(docs):
                    to = max(at + 1, int(np.searchsorted(own, own[at] + block, "right")) - 1)
                    data = tokens[own[at] : own[to]].astype("<u4")
                    cuts = ((own[at : to + 1] - own[at]) * 4).astype("<i4")
                    ids = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
                    keys = pa.array(docs[at:to], mask=docs[at:to] == NO_ID)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(idx[at:to]), ids], ["doc_id", "start", "ids"])
                    at = to

    return _one_each(parts).mapInArrow(read, "doc_id long, start long, ids binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    return read_token_files(write_token_files(docs, path)).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32"))
