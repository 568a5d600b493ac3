"""Bounded-space packing of token sequences.

Each partition keeps a fixed number of open windows. A document's full windows leave at once; its rest goes to the open
window that it fits best. When none fits and no window may be opened, the fullest is topped up with the first ids of the
rest and leaves full. What stays open at the end of a partition is less than one window; these leftovers are merged by
the same rule in rounds, each over a fixed number of earlier leftovers. The last leftover is cut at powers of two, which
need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, col, materialize
from tidemark.llm.tokens import tokenizer

WINDOW = 2048
OPEN_WINDOWS = 32
#: Leftovers of so many partitions are merged in one task of a round.
FAN_IN = 64
END_ID = 1


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: np.ndarray
    total: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:at], self.total), Piece(self.doc, self.start + at, self.ids[at:], self.total)


@dataclass
class Window:
    pieces: list[Piece] = field(default_factory=list)
    filled: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.filled += len(piece.ids)


class Packer:
    """Pieces in; full windows out, as they fill."""

    def __init__(self, size: int = WINDOW, windows: int = OPEN_WINDOWS) -> None:
        self.size, self.windows = size, windows
        self.open: list[Window] = []

    def add(self, piece: Piece) -> Iterator[Window]:
        while len(piece.ids) >= self.size:
            head, piece = piece.cut(self.size)
            yield Window([head], self.size)
        while len(piece.ids):
            fits = [w for w in self.open if w.filled + len(piece.ids) <= self.size]
            if fits:
                best = max(fits, key=lambda w: w.filled)
                best.add(piece)
                if best.filled == self.size:
                    self.open.remove(best)
                    yield best
                return
            if len(self.open) < self.windows:
                self.open.append(Window([piece], len(piece.ids)))
                return
            fullest = max(self.open, key=lambda w: w.filled)
            head, piece = piece.cut(self.size - fullest.filled)
            fullest.add(head)
            self.open.remove(fullest)
            yield fullest

    def finish(self) -> tuple[list[Window], Window]:
        """The open windows run together: full ones, and one that isn't full."""
        full, last = [], Window()
        for piece in (p for w in sorted(self.open, key=lambda w: -w.filled) for p in w.pieces):
            while last.filled + len(piece.ids) >= self.size:
                head, piece = piece.cut(self.size - last.filled)
                last.add(head)
                full.append(last)
                last = Window()
            if len(piece.ids):
                last.add(piece)
        self.open = []
        return full, last


def powers_of_two(last: Window) -> Iterator[Window]:
    """Windows of falling powers of two with the ids of one window."""
    window, want = Window(), 0
    left = last.filled
    for piece in last.pieces:
        while len(piece.ids):
            want = want or 1 << (left.bit_length() - 1)
            head, piece = piece.cut(min(len(piece.ids), want - window.filled))
            window.add(head)
            if window.filled == want:
                left -= want
                yield window
                window, want = Window(), 0


def _rows(windows: list[tuple[int, Window]], is_open: bool, part: int, id_type: pa.DataType) -> pa.RecordBatch:
    flat = [(seq, p) for seq, w in windows for p in w.pieces]
    offsets, at, last = [], 0, None
    for seq, p in flat:
        at = at if seq == last else 0
        offsets.append(at)
        at, last = at + len(p.ids), seq
    return pa.RecordBatch.from_arrays([
        pa.array([p.doc for _, p in flat], id_type), pa.array([p.start for _, p in flat], pa.int64()),
        pa.array([len(p.ids) for _, p in flat], pa.int64()), pa.array([p.total for _, p in flat], pa.int64()),
        pa.array([seq for seq, _ in flat], pa.int64()), pa.array(offsets, pa.int64()),
        pa.array([p.ids.astype("<u4").tobytes() for _, p in flat], pa.binary()),
        pa.array([is_open] * len(flat), pa.bool_()), pa.array([part] * len(flat), pa.int64()),
    ], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "open", "part"])


_REST = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean, part long"
#: A sequence's id: the round that made it, its task, and its number there.
_ROUND, _TASK = 56, 32


def pack_documents(docs: DataFrame, path: str, size: int = WINDOW, windows: int = OPEN_WINDOWS, end_id: int = END_ID, fan_in: int = FAN_IN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A document's ids are the tokenizer's and then ``end_id``; a null or empty text is ``end_id`` alone. Every sequence is
    ``size`` ids long, but for the last ones, which are powers of two. Repeated rows are packed each on its own. An empty
    table gives no rows. A very long text gives full windows as it is cut; columns beside the two named are not read.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    bare = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    id_kind = bare.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_kind}, {_REST}"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk, packer, part, made, id_type = tokenizer(path), Packer(size, windows), TaskContext.get().partitionId(), 0, pa.int64()
        base = part << _TASK
        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, starts = tk.encode(batch.column(1))
            out = []
            for k, doc in enumerate(batch.column(0).to_pylist()):
                own = np.append(ids[starts[k] : starts[k + 1]], np.uint32(end_id))
                for w in packer.add(Piece(doc, 0, own, len(own))):
                    out.append((base + made, w))
                    made += 1
            if out:
                yield _rows(out, False, part, id_type)
            for w in packer.open:  # views of the batch's ids would keep all of them
                for p in w.pieces:
                    p.ids = p.ids.copy() if p.ids.base is not None else p.ids
        full, last = packer.finish()
        if full:
            yield _rows([(base + made + i, w) for i, w in enumerate(full)], False, part, id_type)
        if last.filled:
            yield _rows([(base + made + len(full), last)], True, part, id_type)

    packed = materialize(bare.mapInArrow(pack, schema), "packed")
    done = [packed.where(~F.col("open"))]
    left, step = packed.where("open"), 0
    while True:
        step += 1
        top = left.agg(F.max("part").alias("m")).first()["m"]
        if top is None:
            break
        final = top < fan_in
        groups = top // fan_in + 1
        dealt = left.withColumn("part", F.floor(F.col("part") / fan_in).cast("long")).repartition(int(min(groups, 1024)), "part").sortWithinPartitions("part", "sequence_id", "offset")
        merged = materialize(dealt.mapInArrow(_merger(size, windows, step, final), schema), "leftovers")
        done.append(merged.where(~F.col("open")))
        if final:
            break
        left = merged.where("open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("open", "part")


def _merger(size: int, windows: int, step: int, final: bool):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, id_type, out = None, Packer(size, windows), pa.int64(), []

        def close() -> Iterator[pa.RecordBatch]:
            base = (step << _ROUND) + (part << _TASK)
            full, last = packer.finish()
            ends = [*out, *full, *(powers_of_two(last) if final else [])]
            if ends:
                yield _rows([(base + i, w) for i, w in enumerate(ends)], False, part, id_type)
            if last.filled and not final:
                yield _rows([(base + len(ends), last)], True, part, id_type)
            out.clear()

        for batch in batches:
            id_type = batch.schema.field(0).type
            for row in batch.to_pylist():
                if part is not None and row["part"] != part:
                    yield from close()
                part = row["part"]
                out += packer.add(Piece(row["doc_id"], row["start"], np.frombuffer(row["ids"], "<u4"), row["doc_tokens"]))
        if part is not None:
            yield from close()

    return merge


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    out = pack_documents(docs, path)
    return out.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def whole_sequences(docs: DataFrame, path: str, **options) -> DataFrame:
    """One row a sequence: sequence_id, length and its ids, ready to be trained on."""
    pieces = pack_documents(docs, path, **options)
    gathered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), gathered.alias("p")).select(
        "sequence_id", "length", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
