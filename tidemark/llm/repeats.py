"""Removal of repeated byte strings by a distributed difference cover.

A string of ``window`` bytes is repeated if it also starts in a document with a smaller id. As in suffix sorting by a
difference cover, only the suffixes at sampled positions are named and sorted: those whose place modulo PERIOD is in COVER.
Any two places have a common shift below PERIOD at which both are sampled, so two equal windows hold equal sampled strings
of window - PERIOD + 1 bytes at one distance from their starts, and all other suffixes are merged through these.

1. Names. A symbol is 8 bytes; triples of symbols are named, then triples of names, until a name covers the sampled string. Only
   equal strings must get equal names here, so a name is a 64-bit hash of its triple and needs no sort of its own.
2. Each run of text sends its sorted names, as differences of leading bits, to ranges of names. A range tells which of them are
   found in more than one document; most are not, and go no further.
3. Of those that are left, each run sends the whole names, sorted, with the bytes at either side that a window around them can have, and
   the document. In its range they are sorted, and for each of the PERIOD places of a window around the name, neighbours with equal
   prefixes are compared: a window whose group has a smaller document is repeated.
4. Runs mark what these windows cover.

Texts are never shuffled: runs are cut anew from the same rows each time, and what a range answers lies in the shared folder, a file a
task. Shuffled are about 2 bytes for each sampled place and 16 for each repeated one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import files
from tidemark.llm.common import append_columns, arrow_batches, col, fresh, materialize, runs, scratch_path

WINDOW = 50
#: A perfect difference cover: every distance modulo PERIOD is that of two of its members.
PERIOD, COVER = 7, (0, 1, 3)
SIDE = PERIOD - 1
SYMBOL = 8
#: Bytes of text in a run, and for each range of names. Longer documents are cut into chunks that overlap by a window less a byte.
RUN_BYTES, RANGE_BYTES = 5 << 20, 8 << 20
#: Bits of the table that tells most samples that aren't repeated.
SIEVE = 24
#: Leading bits of a name beyond the logarithm of their number: 1 in 64 names that aren't repeated goes on for nothing.
SPARE_BITS = 6
#: Stands for a null id: smaller than all others.
NO_ID = -(1 << 63)

#: Sampled places that are named at once.
BLOCK = 1 << 15

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def _scramble(x: np.ndarray) -> np.ndarray:
    """Every bit of x spread over all of them; x itself is changed."""
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def names(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Names of the strings of ``length`` bytes at some ascending places of ``data``, a block of the data at a time."""
    out = np.empty(len(at), "u8")
    for first in range(0, len(at), BLOCK):
        own = at[first : first + BLOCK]
        low = int(own[0])
        out[first : first + BLOCK] = _names(data[low : int(own[-1]) + length], own - low, length)
    return out


def _names(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    symbols = np.ndarray((len(data) - SYMBOL + 1,), "<u8", data, strides=(1,))
    name, covered = _scramble(symbols.copy()), SYMBOL
    while covered < length:
        wide = min(3 * covered, length)
        middle, last = (wide - covered) // 2, wide - covered
        if wide == length:
            first, second, third = name[at], name[at + middle], name[at + last]
        else:
            n = len(name) - last
            first, second, third = name[:n].copy(), name[middle : middle + n], name[last : last + n]
        first *= _M1
        first += second
        first *= _M3
        first += third
        name, covered = first, wide
    return _scramble(name if length > SYMBOL else name[at])


@dataclass
class Run:
    """Chunks of documents one after another: where they begin, how long they are, whose they are, and where in the document."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    docs: np.ndarray
    places: list[tuple[int, int]]  # offset in the document, and its whole length

    @property
    def digest(self) -> int:
        return int.from_bytes(hashlib.blake2b(self.sizes.tobytes() + self.docs.tobytes(), digest_size=7).digest(), "little")

    def sampled(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, chunks, names) of the sampled strings."""
        length = window - SIDE
        longest = int(self.sizes.max(initial=0))
        pattern = (np.arange(0, longest + PERIOD, PERIOD)[:, None] + np.array(COVER)).ravel()
        many = np.where(self.sizes >= window, np.searchsorted(pattern, self.sizes - length, "right"), 0)
        at = np.concatenate([pattern[:0], *(pattern[:n] + first for n, first in zip(many.tolist(), self.starts.tolist(), strict=True) if n)])
        return at, np.repeat(np.arange(len(self.sizes), dtype="i4"), many), names(self.data, at, length)


def cut_runs(rows: Iterator[tuple[int | None, bytes]], window: int, run_bytes: int) -> Iterator[Run]:
    """Runs of about ``run_bytes``, whatever the batches are in which rows come. A document is one chunk at least."""
    held: list[bytes] = []
    docs, places, size = [], [], 0

    def run() -> Run:
        sizes = np.array([len(c) for c in held], "i8")
        return Run(np.frombuffer(b"".join(held) + bytes(SYMBOL), "u1"), np.cumsum(sizes) - sizes, sizes, np.array(docs, "i8"), places)

    for doc, text in rows:
        for first in range(0, max(1, len(text) - window + 1), run_bytes):
            held.append(text[first : first + run_bytes + window - 1])
            docs.append(NO_ID if doc is None else doc)
            places.append((first, len(text)))
            size += len(held[-1])
            if size >= run_bytes:
                yield run()
                held, docs, places, size = [], [], [], 0
    if held:
        yield run()


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes, as many as the largest needs."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view("u1").reshape(-1, 8)[:, :width]
    return bytes([width]) + zstandard.ZstdCompressor(1).compress(planes.T.tobytes())


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:], max_output_size=8 * n), "u1").reshape(packed[0], n)
    out = np.zeros((n, 8), "u1")
    out[:, : packed[0]] = planes.T
    return out.view("<u8")[:, 0]


def _differences(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.uint64(0))


def _part(name: np.ndarray, parts: int) -> np.ndarray:
    """The range of names, ascending with them."""
    return ((name >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype("i4")


class _Samples:
    """The sampled strings of a run by their leading bits."""

    def __init__(self, run: Run, window: int, bits: int) -> None:
        self.run, self.window, self.low = run, window, np.uint64(64 - bits)
        self.at, self.chunk, self.name = run.sampled(window)

    def listed(self) -> tuple[np.ndarray, np.ndarray]:
        """The different leading bits, ascending, and which of them stand in several documents of this run."""
        docs, of = np.unique(self.run.docs, return_inverse=True)
        if len(docs) <= 1 << int(self.low):  # document numbers fit below the leading bits
            both = np.sort(self.name >> self.low << self.low | of.astype("u8")[self.chunk])
            short, doc = both >> self.low, both & ((np.uint64(1) << self.low) - np.uint64(1))
        else:
            short, doc = self.name >> self.low, of[self.chunk]
            order = np.lexsort((doc, short))
            short, doc = short[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, "i8")
        return short[first], doc[first] != doc[np.append(first[1:], len(short)) - 1] if len(short) else np.zeros(0, bool)

    def repeated(self, answers: Callable[[int], np.ndarray]) -> np.ndarray:
        """Which samples have leading bits that the ranges have found repeated; ``answers`` gives those for the n listed ones."""
        short = self.name >> self.low
        every = np.sort(short)
        every = every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every
        hit = every[answers(len(every)).astype(bool)]
        # Most samples are told by a table of hashed bits, which lets some pass that aren't hits.
        seen = np.zeros(1 << SIEVE, bool)
        seen[(hit & np.uint64((1 << SIEVE) - 1)).astype("i4")] = True
        own = np.flatnonzero(seen[(short & np.uint64((1 << SIEVE) - 1)).astype("i4")])
        place = np.minimum(np.searchsorted(hit, short[own]), max(0, len(hit) - 1))
        return own[hit[place] == short[own]] if len(hit) else own[:0]


class _Entries:
    """The repeated samples of a run: names with the bytes at their sides, once each, with the least document that has them."""

    def __init__(self, samples: _Samples, own: np.ndarray) -> None:
        run, window = samples.run, samples.window
        self.at, chunk, name = samples.at[own], samples.chunk[own], samples.name[own]
        offset, room = self.at - run.starts[chunk], run.sizes[chunk] - (self.at - run.starts[chunk]) - (window - SIDE)
        self.left, self.right = np.minimum(offset, SIDE), np.minimum(room, SIDE)
        padded = np.concatenate([np.zeros(SYMBOL, "u1"), run.data])
        big = np.ndarray((max(0, len(padded) - SYMBOL + 1),), ">u8", padded, strides=(1,))
        eight = np.uint64(8)
        low = lambda n: (np.uint64(1) << (n.astype("u8") * eight)) - np.uint64(1)
        before = big[self.at].astype("u8") & low(self.left)
        after = big[self.at + window - SIDE + SYMBOL].astype("u8") >> np.uint64(16) & ~low(SIDE - self.right)
        room_ = (self.left * 8 + self.right).astype("u8")
        doc = run.docs[chunk]
        order = np.argsort(name)
        same = name[order][1:] == name[order][:-1]
        if same.any():  # names that stand several times in the run are set in order by the bytes at their sides
            several = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
            sub = order[several]
            order[several] = sub[np.lexsort((room_[sub], after[sub], before[sub], name[sub]))]
        columns = [c[order] for c in (name, before, after, room_)]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], 0)
        first = np.flatnonzero(new)
        self.name, self.before, self.after, self.room = (c[first] for c in columns)
        self.doc = np.minimum.reduceat(doc[order], first) if len(first) else doc[:0]
        self.of = np.empty(len(order), "i8")
        self.of[order] = np.cumsum(new) - 1
        self.later = doc > self.doc[self.of]

    def windows(self, answers: np.ndarray) -> np.ndarray:
        """Starts of the run's repeated windows, given what the ranges answer for each entry."""
        own, out = answers[self.of], []
        for shift in range(PERIOD):
            hit = (shift <= self.left) & (SIDE - shift <= self.right) & (self.later | (own >> shift & 1).astype(bool))
            out.append(self.at[hit] - shift)
        return np.concatenate(out)


def _answers(name: np.ndarray, before: np.ndarray, after: np.ndarray, room: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry of a range, a bit for each place of a window around the name: whether a smaller document has that window."""
    out = np.zeros(len(name), "u1")
    order = np.argsort(name)
    same = name[order][1:] == name[order][:-1]
    several = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order  # a name that stands once has no partner
    left, right = room[several] >> np.uint64(3), room[several] & np.uint64(7)
    for shift in range(PERIOD):
        own = several[(left >= shift) & (right >= SIDE - shift)]
        # The window's bytes beside the name: the last ones before it, the first ones after it.
        beside = (before[own] & np.uint64((1 << 8 * shift) - 1)) << np.uint64(8 * (SIDE - shift)) | after[own] >> np.uint64(8 * shift)
        order = np.argsort(_scramble(beside * _M1 + name[own]))  # one number a window: equal ones are neighbours
        own, beside = own[order], beside[order]
        if not len(own):
            continue
        new = np.concatenate([[True], (name[own][1:] != name[own][:-1]) | (beside[1:] != beside[:-1])])
        first = np.minimum.reduceat(doc[own], np.flatnonzero(new))[np.cumsum(new) - 1]
        out[own[doc[own] > first]] |= np.uint8(1 << shift)
    return out


_LISTS = "part int, task int, turn int, digest long, n int, names binary, shared binary"
_ENTRIES = "part int, task int, turn int, digest long, n int, names binary, before binary, after binary, room binary, doc binary"
_REPLIES = "part int, task int, turn int, digest long, n int, answer binary"
_HEAD = 3


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            yield doc, text or b""


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _cut_by_part(run: Run, turn: int, part: np.ndarray, parts: int, columns: Callable[[slice], tuple]) -> list[tuple]:
    """A row for each range that a sorted list of a run reaches."""
    edges, task, digest = np.searchsorted(part, np.arange(parts + 1)), TaskContext.get().partitionId(), run.digest
    return [(int(p), task, turn, digest, int(edges[p + 1] - edges[p]), *columns(slice(edges[p], edges[p + 1]))) for p in np.flatnonzero(np.diff(edges))]


def _each_part(sent: DataFrame, parts: int, answer: Callable[[pa.Table], list[bytes]]) -> DataFrame:
    """Answers to the rows of each range, which meet in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["part"]):
            keys = [table.column(c).to_pylist() for c in ("part", "task", "turn", "digest", "n")]
            yield _batch(list(zip(*keys, answer(table), strict=True)), _REPLIES)

    return sent.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(run, _REPLIES)


def _store(replies: DataFrame, folder: str) -> None:
    """Write the answers to each task's runs into one file, ranges in order. A file has its name once it is
    whole, and a repeated task gives the same bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["task"]):
            task, turns, digests, answers = (table.column(c).to_pylist() for c in ("task", "turn", "digest", "answer"))
            whole: dict[int, list[bytes]] = {}
            for turn, a in zip(turns, answers, strict=True):
                whole.setdefault(turn, []).append(a)
            attempt = f"{folder}/{task[0]}-{TaskContext.get().taskAttemptId()}"
            with files.create(attempt) as out:
                for turn, found in whole.items():
                    joined = zstandard.ZstdCompressor(3).compress(b"".join(map(zstandard.ZstdDecompressor().decompress, found)))
                    out.write(np.array([turn, digests[turns.index(turn)], len(joined)], "<i8").tobytes() + joined)
            files.move(attempt, f"{folder}/{task[0]}")
            yield pa.RecordBatch.from_arrays([pa.array([task[0]], pa.int32())], ["task"])

    materialize(replies.repartition("task").sortWithinPartitions("task", "turn", "part").mapInArrow(run, "task int"), "answered")


class _Stored:
    """A task's answers by run."""

    def __init__(self, folder: str) -> None:
        self.folder, self.at = folder, None

    def of(self, turn: int, run: Run, n: int) -> np.ndarray:
        """The answers for the n items that a run has sent."""
        if not n:
            return np.zeros(0, "u1")
        if self.at is None:
            self.data, self.at, i = files.array(f"{self.folder}/{TaskContext.get().partitionId()}", "u1"), {}, 0
            while i < len(self.data):
                key, digest, size = self.data[i : i + 8 * _HEAD].view("<i8").tolist()
                self.at[key] = digest, i + 8 * _HEAD, size
                i += 8 * _HEAD + size
        digest, first, size = self.at.get(turn, (None, 0, 0))
        answers = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data[first : first + size].tobytes()), "u1") if size else np.zeros(0, "u1")
        if digest != run.digest or len(answers) != n:
            raise RuntimeError("the documents came in another order when they were read again: pass written=False")
        return answers


def _answered_names(table: pa.Table) -> list[bytes]:
    sizes = table.column("n").to_pylist()
    found = [np.cumsum(_unpack(a, n)) for a, n in zip(table.column("names").to_pylist(), sizes, strict=True)]
    shared = [np.unpackbits(np.frombuffer(a, "u1"), count=n) for a, n in zip(table.column("shared").to_pylist(), sizes, strict=True)]
    every = np.concatenate(found)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    repeated = np.concatenate(shared).astype(bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    return _cut_answers(repeated.astype("u1"), sizes)


def _cut_answers(every: np.ndarray, sizes: list[int]) -> list[bytes]:
    to = np.cumsum(sizes)
    return [zstandard.ZstdCompressor(1).compress(every[b - n : b].tobytes()) for b, n in zip(to, sizes, strict=True)]


def _answered_entries(table: pa.Table) -> list[bytes]:
    sizes = table.column("n").to_pylist()
    of = lambda c: [_unpack(a, n) for a, n in zip(table.column(c).to_pylist(), sizes, strict=True)]
    name = np.concatenate([np.cumsum(d) for d in of("names")])
    before, after, room = (np.concatenate(of(c)) for c in ("before", "after", "room"))
    doc = np.concatenate(of("doc")).view("i8")
    return _cut_answers(_answers(name, before, after, room, doc), sizes)


def mark_repeats(
    docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", columns: tuple[str, str, str, str, str] = ("n_bytes", "n_removed", "n_spans", "spans", "kept"),
    written: bool = False, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (long), spans (array of first and end byte) and kept (the bytes that stay).

    A byte goes if a string of ``window`` bytes around it also starts in a document with a smaller id; strings are judged on the
    texts as they are, and don't cross documents. ``written`` says that docs come straight from files, whose rows come in the same order
    whenever they are read; else they are written first. If they do not, that is found out and raised.

    A null text counts as empty, texts shorter than a window stay whole; rows of one id don't take from each other, a null id is
    smaller than all others (ids are integers). Equal texts of a larger id go whole. Very long texts are cut into chunks that overlap, and
    judged whole. An empty table stays empty. Columns named as ``columns`` are replaced, all others stay.
    """
    if not 2 * SIDE + SYMBOL <= window <= 255:
        raise ValueError(f"a window has {2 * SIDE + SYMBOL} to 255 bytes")
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs if written else materialize(docs, "documents")
    bare = docs.select(col(doc_id).cast("long").alias("id"), col(text).alias("text"))
    total = bare.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    bits = min(64, max(33, math.ceil(math.log2(max(2, total * len(COVER) / PERIOD))) + SPARE_BITS))
    first, second = scratch_path(spark, "repeated-names"), scratch_path(spark, "repeated-windows")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, run in enumerate(cut_runs(_rows(batches), window, run_bytes)):
            own = _Samples(run, window, bits)
            short, shared = own.listed()
            rows = _cut_by_part(run, turn, _part(short << own.low, parts), parts, lambda s, v=short, m=shared: (_pack(_differences(v[s])), np.packbits(m[s]).tobytes()))
            if rows:
                yield _batch(rows, _LISTS)

    def _entries(run: Run, turn: int, stored: _Stored) -> _Entries:
        samples = _Samples(run, window, bits)
        return _Entries(samples, samples.repeated(lambda n: stored.of(turn, run, n)))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = _Stored(first)
        for turn, run in enumerate(cut_runs(_rows(batches), window, run_bytes)):
            e = _entries(run, turn, stored)
            rows = _cut_by_part(run, turn, _part(e.name, parts), parts, lambda s, e=e: (
                _pack(_differences(e.name[s])), _pack(e.before[s]), _pack(e.after[s]), _pack(e.room[s]), _pack(e.doc[s].view("u8"))))
            if rows:
                yield _batch(rows, _ENTRIES)

    _store(_each_part(bare.mapInArrow(lists, _LISTS), parts, _answered_names), first)
    _store(_each_part(bare.mapInArrow(entries, _ENTRIES), parts, _answered_entries), second)
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    added = [T.StructField(c, k) for c, k in zip(fresh(docs, *columns), [T.LongType()] * 3 + [span, T.BinaryType()], strict=True)]
    at = [docs.columns.index(doc_id), docs.columns.index(text)]

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        """Rows leave with their batch, once the last of its documents is marked."""
        waiting: list[pa.RecordBatch] = []
        done: list[tuple] = []
        one, two = _Stored(first), _Stored(second)

        def rows() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                waiting.append(batch)
                yield from _rows(iter([pa.RecordBatch.from_arrays([batch.column(at[0]).cast(pa.int64()), batch.column(at[1])], ["id", "text"])]))

        def ready(last: bool = False) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
            while waiting and (len(done) >= waiting[0].num_rows > 0 or last or not waiting[0].num_rows):
                n = waiting[0].num_rows
                own = [list(c) for c in zip(*done[:n], strict=True)] or [[]] * 5
                del done[:n]
                yield waiting.pop(0), [pa.array(c, k) for c, k in zip(own, [pa.int64()] * 3 + [pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.binary()], strict=True)]

        parts_of: list[np.ndarray] = []
        covered = np.zeros(0, bool)
        for turn, run in enumerate(cut_runs(rows(), window, run_bytes)):
            e = _entries(run, turn, one)
            begin = np.zeros(len(run.data) + window, "i4")
            begin[e.windows(two.of(turn, run, len(e.name)))] = 1
            over = np.cumsum(begin - np.concatenate([np.zeros(window, "i4"), begin[:-window]])) > 0
            for first_, size, (offset, whole) in zip(run.starts.tolist(), run.sizes.tolist(), run.places, strict=True):
                if not offset:
                    covered, parts_of = np.zeros(whole, bool), []
                covered[offset : offset + size] |= over[first_ : first_ + size]
                parts_of.append(run.data[first_ : first_ + size] if offset + size == whole else run.data[first_ : first_ + size - window + 1])
                if offset + size == whole:
                    data = np.concatenate(parts_of)
                    edges = np.flatnonzero(np.diff(covered, prepend=False, append=False))
                    done.append((whole, int(covered.sum()), len(edges) // 2, [{"first": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()], data[~covered].tobytes()))
            yield from ready()
        yield from ready(True)

    marked = append_columns(docs, marks, added)
    return marked.drop(*[c for c in docs.columns if c in columns]).withColumnsRenamed({f.name: c for f, c in zip(added, columns, strict=True)})


def digests(docs: DataFrame, written: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    marked = mark_repeats(docs.select("doc_id", "text"), written=written)
    return marked.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
