"""Document fingerprints from closed syncmers.

A k-mer of a text (k code points) is an anchor if the least hash among its inner s-mers stands at its first or its last
place. Whether it is one depends on its own characters alone, so an edit changes only the anchors that it touches, and two
texts choose the same anchors in every passage that they share. A fingerprint is the sketch of a text's anchors: its
SKETCH smallest distinct anchor hashes of each scale, all of them if there are fewer. A hash tells its scale, and two texts
are compared over the scales that both have.

Passages are matched by position: anchors that two texts share and that lie equally far apart in both are one passage. Two
anchors that follow each other overlap, so such a run is equal code point by code point, and it is extended to both sides as
far as the texts agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import HEAD, MOST_PARTS, arrow_batches, col, range_bounds, range_part, text_parts

K, S = 24, 6
#: Texts of fewer code points than SHORT are anchored at a finer scale, too.
SHORT, FINE_K, FINE_S = 256, 8, 3
#: The bit of a hash that tells its scale, the lowest that a sketch keeps: set if fine.
FINE = np.uint64(1 << 32)
SKETCH = 128
#: Code points that are hashed at once.
CHUNK = 1 << 18
#: Bytes of text that a range of documents should hold, on average.
PART_BYTES = 64 << 20
#: Orders a null document id below all others.
NO_ID = -(1 << 63)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = CHUNK + K
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, "u8"))]) for b in (_BASE, _BACK))


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _grams(prefix: np.ndarray, back: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n-gram from prefix sums of code point times power: the same n-gram has the same hash anywhere."""
    return _mix((prefix[n:] - prefix[:-n]) * back[: len(prefix) - n])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width``: windows double, and two that overlap make up the rest."""
    have = 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if have < width else h


def _syncmers(points: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of a text of k code points or more."""
    forth, back = _powers()
    where, what = [], []
    for at in range(0, len(points) - k + 1, CHUNK):
        part = points[at : at + CHUNK + k - 1]
        prefix = np.concatenate([np.zeros(1, "u8"), np.cumsum(part * forth[: len(part)], dtype="u8")])
        inner = _grams(prefix, back, s)
        width = k - s + 1
        least = _least(inner, width)
        chosen = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
        where.append(chosen + at)
        what.append(_mix((prefix[chosen + k] - prefix[chosen]) * back[chosen]))
    found = np.concatenate(what)
    return np.concatenate(where), found | FINE if k == FINE_K else found & ~FINE


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points) and hashes of a text's anchors, in ascending position.

    A text of fewer than SHORT code points also has the anchors of a finer scale, since few of the coarse ones fall into
    it. A text shorter than a fine k-mer is one fine anchor, unless empty.
    """
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("u8") + np.uint64(1)
    n = len(points)
    if n >= SHORT:
        return _syncmers(points, K, S)
    if n < FINE_K:
        return (np.zeros(1, "i8"), _whole(text)) if n else (np.zeros(0, "i8"), np.zeros(0, "u8"))
    where, what = _syncmers(points, FINE_K, FINE_S)
    if n >= K:
        more = _syncmers(points, K, S)
        where, what = np.concatenate([where, more[0]]), np.concatenate([what, more[1]])
        order = np.argsort(where, kind="stable")
        where, what = where[order], what[order]
    return (where, what) if len(where) else (np.zeros(1, "i8"), _whole(text))


def _whole(text: str) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(text.encode(), digest_size=8).digest(), "<u8") | FINE


def _by_scale(sketched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coarse and the fine hashes of a sketch."""
    fine = (sketched & np.uint32(1)).astype(bool)
    return sketched[~fine], sketched[fine]


def sketch(hashes: np.ndarray, size: int | None = SKETCH) -> np.ndarray:
    """The smallest distinct hashes of each scale, by their upper 32 bits; all of them if ``size`` is None."""
    coarse, fine = _by_scale(np.unique((hashes >> np.uint64(32)).astype("u4")))
    return np.sort(np.concatenate([coarse[:size], fine[:size]])) if len(fine) else coarse[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int | None = SKETCH) -> float:
    """Share of anchors in common, 2 |A & B| / (|A| + |B|), exact if both sketches hold all anchors, else estimated from
    the smallest hashes of the union. Fine anchors count only if both texts have them: a long text has none whatever it
    shares with a short one. Two empty texts are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    scales = list(zip(_by_scale(a), _by_scale(b), strict=True))
    if not all(map(len, scales[1])):
        del scales[1]
    both = every = 0
    for x, y in scales:
        union = np.union1d(x, y)
        if size is not None and max(len(x), len(y)) >= size:
            union = union[:size]
        both += len(np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True))
        every += len(union)
    jaccard = both / every
    return 2 * jaccard / (1 + jaccard)


def encode(sketched: np.ndarray) -> str:
    return sketched.astype(">u4").tobytes().hex()


def spliced(a: str, a_anchors: tuple, b: str, b_anchors: tuple, keep: int, take: int) -> np.ndarray:
    """Anchor hashes of a[:keep] + b[:take]. Those inside either part are known; only k-mers over the joint are new."""
    if min(len(a), len(b), keep + take) < SHORT:
        return anchors(a[:keep] + b[:take])[1]
    head = a_anchors[1][: np.searchsorted(a_anchors[0], keep - K, "right")]
    tail = b_anchors[1][: np.searchsorted(b_anchors[0], take - K, "right")]
    joint = np.frombuffer((a[max(0, keep - K + 1) : keep] + b[: min(take, K - 1)]).encode("utf-32-le"), "<u4").astype("u8") + np.uint64(1)
    over = _syncmers(joint, K, S)[1] if len(joint) >= K else a_anchors[1][:0]
    return np.concatenate([head, over, tail])


def _numbered(found: tuple[np.ndarray, np.ndarray], fine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys and positions of a text's anchors of one scale: a hash that stands there several times gets a key each time."""
    where, what = found
    own = ((what & FINE) != 0) == fine
    where, what = where[own], what[own]
    order = np.argsort(what, kind="stable")
    what = what[order]
    nth = (np.arange(len(what)) - np.searchsorted(what, what)).astype("u8")
    return _mix(what + nth * _BASE), where[order]


def _agree(a: str, b: str) -> int:
    """How many code points are equal from the first on."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def passage(a: str, a_anchors: tuple, b: str, b_anchors: tuple) -> tuple[int | None, int | None, int]:
    """(start in a, start in b, code points) of the passage with the longest run of anchors that both texts share at one
    distance, extended as far as they agree; (None, None, 0) if they share no anchor.

    Every passage of 2 K - S code points has an anchor, of 2 FINE_K - FINE_S if both texts are SHORT. An anchor that is
    repeated within the texts pairs in order, the first with the first, so pairs never outnumber anchors. Of equally long
    runs that with the least start in a less start in b counts.
    """
    if a == b:
        return 0, 0, len(a)
    fine = max(len(a), len(b)) < SHORT
    k = FINE_K if fine else K
    (x, at_a), (y, at_b) = _numbered(a_anchors, fine), _numbered(b_anchors, fine)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return None, None, 0
    at, shift = at_a[i], at_a[i] - at_b[j]
    order = np.lexsort((at, shift))
    at, shift = at[order], shift[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(shift) != 0) | (np.diff(at) > k)]))
    last = np.append(first[1:], len(at)) - 1
    best = first[np.argmax(at[last] - at[first])]
    start, other = int(at[best]), int(at[best] - shift[best])
    back = _agree(a[:start][::-1], b[:other][::-1])
    return start - back, other - back, back + _agree(a[start:], b[other:])


def anchor_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, positions, hashes, fingerprint) of each whole text. Nulls are empty texts: no anchors."""
    arrow_batches(docs.sparkSession)
    bare = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    kind = bare.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([p for p, _ in found], pa.list_(pa.int64())),
                pa.array([h.astype("i8") for _, h in found], pa.list_(pa.int64())), pa.array([encode(sketch(h)) for _, h in found], pa.string()),
            ], ["doc_id", "positions", "hashes", "fingerprint"])

    return bare.mapInArrow(run, f"doc_id {kind}, positions array<bigint>, hashes array<bigint>, fingerprint string")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, borrowed, key, doc_id, text), sorted so that each document is followed by the next in descending id.

    Documents are dealt into ranges of (descending id, beginning of the text); each range also borrows the first document of
    the range after it, and the last one that of the first, so every document but a borrowed one has its follower in its
    own partition. Equal ids follow each other by text. The plan is of one size, however many ranges there are.
    Null ids sort below all others and so come last, null texts stay null, repeated rows stay; very long texts are moved whole; an empty table gives no
    rows, other columns are not read.
    """
    bare = docs.select(F.coalesce(col(doc_id).cast("long"), F.lit(NO_ID)).alias("key"), col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    parts = text_parts(bare, "text", PART_BYTES, MOST_PARTS)
    # Cut points ascend, so ranges are found on the key's complement, which ascends as the key falls.
    down = bare.withColumn("down", F.bitwise_not("key"))
    placed = down.withColumn("part", range_part("down", "text", range_bounds(down, "down", "text", parts)))
    heads = placed.groupBy(F.col("part").alias("of")).agg(F.min("down").alias("head"))
    order = Window.orderBy("of")  # a row a range
    before = F.coalesce(F.lag("of").over(order), F.max("of").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.withColumn("to", before)
    borrowed = placed.join(F.broadcast(heads), (F.col("part") == F.col("of")) & (F.col("down") == F.col("head"))).withColumn("part", F.col("to"))
    columns = ["part", "borrowed", "key", "doc_id", "text"]
    both = placed.withColumn("borrowed", F.lit(False)).select(*columns).unionByName(borrowed.withColumn("borrowed", F.lit(True)).select(*columns))
    return both.repartitionById(parts, "part").sortWithinPartitions("part", "borrowed", F.col("key").desc(), "text")


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int | None = SKETCH) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is the beginning of the next document, and how
    alike they are; and the longest passage of the text that the next document has, too: its code points (0 if they share no
    anchor) and where it starts in either.

    ``size`` hashes of each scale are a fingerprint, from which likeness is estimated; with None it has all of them, and likeness is exact. Texts of
    fewer than SHORT code points have a finer scale beside the coarse one, and two texts are compared over the scales that both have.
    Nulls are empty texts; null ids come last. A single document is its own next one; repeated rows follow each other. Very
    long texts are anchored whole, CHUNK code points at a time. An empty table gives no rows; other columns are not read.
    """
    arrow_batches(docs.sparkSession)
    ordered = with_next(docs, doc_id, text)
    kind = ordered.schema["doc_id"].dataType.simpleString()

    def row(own: tuple, after: tuple) -> tuple:
        doc, a, a_anchors, a_sketch = own
        _, b, b_anchors, b_sketch = after
        keep, take = len(a) - len(a) // 3, min(len(a) // 3, len(b))
        digest = hashlib.sha256((a[:keep] + b[:take]).encode()).hexdigest()
        edited = sketch(spliced(a, a_anchors, b, b_anchors, keep, take), size)
        start, next_start, length = passage(a, a_anchors, b, b_anchors)
        return doc, len(a), digest, encode(a_sketch), encode(edited), likeness(a_sketch, edited, size), likeness(a_sketch, b_sketch, size), length, start, next_start

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        part, before, lent = None, None, False
        for batch in batches:
            out = []
            for p, borrowed, doc, t in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if p == part and lent:
                    continue  # a second row with a borrowed id
                t = t or ""
                found = anchors(t)
                now = doc, t, found, sketch(found[1], size)
                if p == part:
                    out.append(row(before, now))
                part, before, lent = p, now, borrowed
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k or batch.schema.field(3).type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "passage_chars", "passage_start", "passage_next_start"])

    return ordered.mapInArrow(rows, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, passage_chars long, passage_start long, passage_next_start long")
