"""N-gram Jaccard join by a MinHash LSH forest.

1. Texts become sets of hashed word shingles; equal sets are one class, whatever its size, and only one representative of
   each goes on.
2. A representative has one label of minima a tree. A tree's labels are sorted, so those with a long common prefix stand
   together, as in a prefix trie. A label's candidates are the two labels before it and the first label with each prefix
   that it shares, so a bucket of any size gives a few candidates a label, not all pairs. Labels are sorted over all
   partitions; what crosses a partition's edge is settled from a small table of those edges, so the candidates don't
   depend on how many partitions there are.
3. Candidate pairs whose signatures rule the threshold out are dropped. The matched prefix starts at a tree's whole depth
   and is shortened, level by level, until the pairs found at a level are the target share of all that the forest can find.
   The rest form groups.
4. Inside a group all pairs are verified on the whole shingle sets. A large group is cut into blocks by set size; two
   blocks whose sizes rule the threshold out never meet, and each other pair of blocks is a task. Tasks return counts of
   links and a spanning forest of the links, never pairs.
"""

from __future__ import annotations

import json
import logging
import math
import re
import warnings
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, col, fresh, join_checked, materialize, runs
from tidemark.llm.graph import components

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 6
#: The shortest prefix that is tried: a pair at the threshold shares so much in some tree with probability 1 - 6e-7.
LEAST_PREFIX = 3
#: Share of the pairs of the shortest prefix at which shortening stops.
RECALL = 0.9999
#: Documents, chosen by a hash, whose similar partners are sought among all signatures, and the share of these that the groups must hold.
PROBES, LEAST_RECALL = 256, 0.99
#: Documents and shingles in a block of a group.
BLOCK, BLOCK_SHINGLES = 256, 1 << 21
#: Code points of a text that are hashed at once (one word at least), and shingles of a task that are counted at once. Results don't depend on them.
PIECE, COUNTED = 1 << 18, 1 << 17
#: Standard errors that a signature may be off before a candidate is dropped.
SLACK = 5.0

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(20_240_501)
_FACTORS = _rng.integers(0, 1 << 32, TREES * DEPTH, "u4") | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, TREES * DEPTH, "u4")
_SPACE = np.zeros(128, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GAP = re.compile(r"[\x20\x09-\x0D]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def _pieces(text: str) -> Iterator[str]:
    """A text in runs of about PIECE code points; no word is cut."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to


def _words(text: str) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    inside = ~((points < 128) & _SPACE[np.minimum(points, 127)])
    edge = np.diff(inside.astype("i1"), prepend=0)
    first = np.flatnonzero(edge == 1)
    if not len(first):
        return np.zeros(0, "u8")
    at = np.flatnonzero(inside)
    length = np.diff(np.append(np.searchsorted(at, first), len(at)))
    place = (at - np.repeat(first, length)).astype("u8")
    letters = _mix(points[at].astype("u8") + (place << np.uint64(32)))
    return _mix(np.add.reduceat(letters, np.cumsum(length) - length))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of ``size`` words; a shorter text is one run, one without words none."""
    word = np.concatenate([np.zeros(0, "u8"), *map(_words, _pieces(text or ""))])
    if not len(word):
        return word
    n = min(size, len(word))
    run = np.full(len(word) - n + 1, np.uint64(n))
    for k in range(n):
        run *= _M1
        run += word[k : k + len(run)]
    return np.unique(_mix(run))


def signature(found: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima of a shingle set, 16 bits of each."""
    h = (found >> np.uint64(32)).astype("u4")[:, None]
    low = np.full(len(_FACTORS), 0xFFFFFFFF, "u4")
    for a in range(0, len(h), 1024):
        np.minimum(low, (h[a : a + 1024] * _FACTORS + _SHIFTS).min(0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")


def set_key(found: np.ndarray) -> int:
    """64 bits that equal sets share."""
    with np.errstate(over="ignore"):
        total = np.array([found.sum(dtype="u8") + np.uint64(len(found)), (found * (found | np.uint64(1))).sum(dtype="u8")], "u8")
        return int(_mix(total[:1] * _M1 + _mix(total[1:]))[0].astype("i8"))


def chance(similarity: np.ndarray, prefix: int, trees: int = TREES) -> np.ndarray:
    """The probability that a pair of this similarity shares the prefix in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, size, sig): the class of equal shingle sets that a text is in, the set's size, and its signature."""
    arrow_batches(docs.sparkSession)
    bare = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ], ["doc_id", "node", "size", "sig"])

    return bare.mapInArrow(run, "doc_id long, node long, size long, sig binary")


class _Edge(NamedTuple):
    """What a partition of sorted labels shows to those after it."""

    part: int
    heads: list  # its first two rows and its last two: (tree, label, node)
    tails: list
    firsts: list  # of its last row, the first row of each prefix inside the partition: (node, whether it is the first row of all)


_TREE = "a long, b long, depth int, part int, waits int, edge string"
_TREE_NAMES = ["a", "b", "depth", "part", "waits", "edge"]


def _places(tree: np.ndarray, label: np.ndarray, node: np.ndarray) -> list[tuple[int, list[int], int]]:
    return list(zip(tree.tolist(), label.tolist(), node.tolist(), strict=True))


def _tree_edges(prefix: int):
    """Pairs of neighbours in sorted labels: each label with the two before it, and with the first that shares its prefix at
    each depth from ``prefix`` on, with the depth of the prefix that both share.

    A label that begins with the prefix of its partition's first label waits: the first label with that prefix may be in an
    earlier partition. It says so by its part and has the first inside the partition for now. The last row of a partition
    is its edge.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, seen = TaskContext.get().partitionId(), None, 0
        heads: list[tuple[int, list[int], int]] = []
        levels = range(prefix, DEPTH + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, node = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, DEPTH)
            place = np.arange(seen, seen + len(node))
            seen += len(node)
            heads = (heads + _places(tree[:2], label[:2], node[:2]))[:2]
            if held is not None:
                tree, node, label, place = (np.concatenate([h, x]) for h, x in zip(held, (tree, node, label, place), strict=True))
            n, new = len(node), 0 if held is None else len(held[1])
            index = np.arange(n)
            change = np.ones((n, DEPTH + 1), bool)
            change[1:, 0] = tree[1:] != tree[:-1]
            for k in range(DEPTH):
                change[1:, k + 1] = change[1:, k] | (label[1:, k] != label[:-1, k])
            firsts = {k: np.maximum.accumulate(np.where(change[:, k], index, 0)) for k in levels}
            same_head = {k: (tree == heads[0][0]) & (label[:, :k] == heads[0][1][:k]).all(1) for k in levels}

            def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                equal = (label[x] == label[y]) & (tree[x] == tree[y])[:, None]
                return np.cumprod(equal, 1).sum(1)

            rows = []  # a, b, depth, whether it waits
            own = index[new:]
            for k in levels:
                open_ = same_head[k][own]
                settled, waits = own[~open_ & (firsts[k][own] != own)], own[open_]
                rows.append((node[settled], node[firsts[k][settled]], shared(settled, firsts[k][settled]), np.zeros(len(settled), bool)))
                rows.append((node[waits], node[firsts[k][waits]], np.full(len(waits), k), np.ones(len(waits), bool)))
            for back in (1, 2):
                behind = own[own >= back]
                inside = behind[firsts[prefix][behind] <= behind - back]
                rows.append((node[inside], node[inside - back], shared(inside, inside - back), np.zeros(len(inside), bool)))
            a, b, depth, waits = (np.concatenate(c) for c in zip(*rows, strict=True))
            keep = (a != b) | waits
            if keep.any():
                yield _tree_rows(a[keep], b[keep], depth[keep], part, waits[keep])
            kept = np.unique([*(f[-1] for f in firsts.values()), max(0, n - 2), n - 1])
            held = tree[kept], node[kept], label[kept], place[kept]
        if held is not None:
            tree, node, label, place = held
            firsts = [np.flatnonzero((tree == tree[-1]) & (label[:, :k] == label[-1, :k]).all(1))[0] for k in levels]
            edge = _Edge(part, heads, _places(tree[-2:], label[-2:], node[-2:]), [(int(node[i]), int(place[i]) == 0) for i in firsts])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.int32()) for _ in range(3)), pa.array([json.dumps(edge)])], _TREE_NAMES)

    return run


def _tree_rows(a: np.ndarray, b: np.ndarray, depth: np.ndarray, part: int, waits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(depth, pa.int32()), pa.array(np.full(len(a), part), pa.int32()),
        pa.array(waits.astype("i4")), pa.nulls(len(a), pa.string())], _TREE_NAMES)


def _common(x: tuple, y: tuple) -> int:
    """How many minima two labels of one tree share from the first on; -1 in different trees."""
    if x[0] != y[0]:
        return -1
    return next((k for k, (i, j) in enumerate(zip(x[1], y[1], strict=True)) if i != j), DEPTH)


def _carried(edges: list[_Edge], prefix: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """From the edges of all partitions: (part, depth, node) of the first label with a prefix that a partition begins in the
    midst of, and the pairs (a, b, depth) of a label and the one or two before it across partitions."""
    firsts, pairs = [], []
    open_: dict[int, int] = {}  # first node of each prefix of the last label so far
    tails: list[tuple] = []  # the last two labels so far
    for edge in sorted(edges):
        common = _common(tails[-1], edge.heads[0]) if tails else -1
        carried = {k: node for k, node in open_.items() if k <= common}
        firsts += [(edge.part, k, node) for k, node in carried.items()]
        for i, head in enumerate(edge.heads):
            for back, tail in enumerate(reversed(tails), 1):
                if i + back <= 2 and (depth := _common(tail, head)) >= prefix:
                    pairs.append((head[2], tail[2], depth))
        open_ = {k: carried[k] if is_head and k in carried else node for k, (node, is_head) in enumerate(edge.firsts, prefix)}
        tails = (tails + edge.tails)[-2:]
    return firsts, pairs


def forest_pairs(reps: DataFrame, prefix: int = LEAST_PREFIX) -> DataFrame:
    """(a, b, depth) of candidate pairs of nodes: the longest prefix that they share in a tree, ``prefix`` at least."""
    spark = reps.sparkSession
    width = 2 * DEPTH
    label = F.substring(F.col("sig"), F.col("tree") * width + 1, F.lit(width))
    labels = reps.where("size > 0").select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("tree", label.alias("label"), "node")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = labels.repartitionByRange(parts, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    walked = materialize(ordered.mapInArrow(_tree_edges(prefix), _TREE), "forest")
    edges = [_Edge(*json.loads(r["edge"])) for r in walked.where("edge is not null").select("edge").collect()]  # a row a partition
    firsts, crossing = _carried(edges, prefix)
    carried = F.broadcast(spark.createDataFrame(firsts, "part int, depth int, first long"))
    settled = walked.where("waits = 0").select("a", "b", "depth").unionByName(spark.createDataFrame(crossing, "a long, b long, depth int"))
    waited = walked.where("waits = 1").join(carried, ["part", "depth"], "left").select("a", F.coalesce("first", "b").alias("b"), "depth").where("a <> b")
    return settled.unionByName(waited).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("depth").alias("depth"))


class Forest(NamedTuple):
    """How far prefixes were shortened, and the share of the forest's similar pairs that have such a prefix; of the pairs that
    the probes have with any document, by signatures alone, how many there are and how many are in one group."""

    prefix: int
    recall: float
    pairs: int
    probed: int = 0
    joined: int = 0


def shortened(counts: dict[int, int], expected: float, target: float) -> Forest:
    """The longest prefix at which the pairs found reach the target share of those expected. ``counts`` has the similar
    pairs by the longest prefix that they share."""
    found = 0
    for prefix in range(DEPTH, LEAST_PREFIX - 1, -1):
        found += counts.get(prefix, 0)
        if not expected or found >= target * expected or prefix == LEAST_PREFIX:
            return Forest(prefix, found / expected if expected else 1.0, found)
    raise AssertionError


def similar_pairs(reps: DataFrame, recall: float = RECALL, threshold: float = THRESHOLD) -> tuple[DataFrame, Forest]:
    """(a, b, depth), written, of nodes whose signatures don't rule the threshold out, with the longest prefix that they share in a tree; and
    how long a prefix is enough.

    A pair counts as similar for the recall if its signatures agree by the threshold. Each pair found stands for the pairs
    of its similarity that share no prefix of LEAST_PREFIX.
    """
    least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / (TREES * DEPTH))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "u2").reshape(-1, TREES * DEPTH) for i in (3, 4))
            share = (x == y).mean(1) if len(x) else np.zeros(0)
            stands = np.where(share >= threshold, 1 / chance(np.maximum(share, threshold), LEAST_PREFIX), 0.0)
            rows = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(stands)], ["a", "b", "depth", "stands"])
            yield rows.filter(pa.array(share >= least))

    one = reps.select(F.col("node").alias("a"), F.col("sig").alias("x"))
    two = reps.select(F.col("node").alias("b"), F.col("sig").alias("y"))
    joined = forest_pairs(reps).join(one, "a").join(two, "b").select("a", "b", "depth", "x", "y")
    similar = materialize(joined.mapInArrow(alike, "a long, b long, depth int, stands double"), "similar")
    levels = similar.where("stands > 0").groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.sum("stands").alias("s")).collect()  # a row a level
    return similar.drop("stands"), shortened({r["depth"]: r["n"] for r in levels}, sum(r["s"] for r in levels), recall)


def probe_pairs(reps: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """(a, b), written, of ``probes`` nodes, chosen by a hash, and all nodes whose signatures agree with theirs by the threshold: each is set
    beside every signature, so what the forest misses is seen, too."""
    some = reps.where("size > 0")
    chosen = some.orderBy(F.xxhash64(F.lit("probe"), "node"), "node").limit(probes).select("node", "sig").collect()  # probes rows
    asked, least = np.array([r["node"] for r in chosen], "i8"), math.ceil(threshold * TREES * DEPTH - 1e-9)
    signs = np.frombuffer(b"".join(bytes(r["sig"]) for r in chosen), "u2").reshape(-1, TREES * DEPTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, own = batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), "u2").reshape(-1, TREES * DEPTH)
            for q, sign in zip(asked.tolist(), signs, strict=True):
                hit = node[(own == sign).sum(1) >= least]
                hit = hit[hit != q]
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), q)), pa.array(hit)], ["a", "b"])

    return materialize(some.select("node", "sig").mapInArrow(run, "a long, b long"), "probes")


def similar_groups(reps: DataFrame, recall: float = RECALL, threshold: float = THRESHOLD, probes: int = PROBES, least_recall: float = LEAST_RECALL) -> tuple[DataFrame, Forest]:
    """(node, root), written, of the groups that candidate pairs form, and what the forest was and measured.

    Prefixes are shortened further while the groups hold less than ``least_recall`` of the probes' pairs, and a warning is given if
    the shortest prefix doesn't reach it."""
    similar, forest = similar_pairs(reps, recall, threshold)
    near = probe_pairs(reps, threshold, probes)
    for prefix in range(forest.prefix, LEAST_PREFIX - 1, -1):
        groups = materialize(components(similar.where(F.col("depth") >= prefix).select("a", "b")), "groups")
        of = lambda side: groups.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        found = near.join(of("a"), "a", "left").join(of("b"), "b", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("root_a") == F.col("root_b")).alias("together")).first()
        forest = forest._replace(prefix=prefix, probed=found["n"], joined=found["together"])
        if forest.joined >= least_recall * forest.probed:
            break
    else:
        warnings.warn(f"groups hold {forest.joined} of {forest.probed} similar pairs of the probes, under {least_recall}", stacklevel=2)
    logging.getLogger(__name__).info("%s", forest)
    return groups, forest


def _verify(threshold: float):
    """Links inside a block, or between two: counts by node, weighted by copies, and a spanning forest."""
    parts = round(threshold * 1000)

    def counted(sets: list[np.ndarray]) -> np.ndarray:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[index] > 1
        owner, index = owner[shared], np.unique(index[shared], return_inverse=True)[1] if shared.any() else index[:0]
        order = np.argsort(index, kind="stable")
        owner, index = owner[order], index[order]
        common = np.zeros((len(sets), len(sets)), "f4")
        columns = int(index[-1]) + 1 if len(index) else 0
        for a in range(0, columns, 4096):
            lo, hi = np.searchsorted(index, [a, a + 4096])
            have = np.zeros((len(sets), min(4096, columns - a)), "f4")
            have[owner[lo:hi], index[lo:hi] - a] = 1
            common += have @ have.T
        return common.astype("i8")

    def overlap(sets: list[np.ndarray]) -> np.ndarray:
        """Shingles that each two sets share, counted by ranges of hashes: a range of all sets has about COUNTED of them."""
        ranges = -(-sum(map(len, sets)) // COUNTED)
        cuts = np.array([k * 2**64 // ranges for k in range(1, ranges)], "u8")
        edges = [[0, *np.searchsorted(s, cuts).tolist(), len(s)] for s in sets]
        common = np.zeros((len(sets), len(sets)), "i8")
        for k in range(ranges):
            common += counted([s[e[k] : e[k + 1]] for s, e in zip(sets, edges, strict=True)])
        return common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["comp", "lo", "hi"]):
            rows: dict[int, tuple[int, int, np.ndarray]] = {}
            for node, block, copies, data in zip(*(group.column(c).to_pylist() for c in ("node", "block", "copies")), group.column("shingles"), strict=True):
                rows[node] = block, copies, np.frombuffer(data.as_buffer(), "<u8")
            if len(rows) < 2:
                continue
            nodes = np.array(list(rows))
            block, copies = (np.array([r[k] for r in rows.values()]) for k in (0, 1))
            sets = [r[2] for r in rows.values()]
            size = np.array([len(s) for s in sets])
            common = overlap(sets)
            linked = 1000 * common >= parts * (size[:, None] + size[None, :] - common)
            np.fill_diagonal(linked, False)
            if group.column("lo")[0].as_py() != group.column("hi")[0].as_py():
                linked &= block[:, None] != block[None, :]
            links = linked @ copies
            a, b, done = [], [], np.zeros(len(nodes), bool)
            for start in np.flatnonzero(links):
                todo = [start] if not done[start] else []
                done[start] = True
                while todo:
                    i = todo.pop()
                    new = np.flatnonzero(linked[i] & ~done)
                    done[new] = True
                    a += [nodes[i]] * len(new)
                    b += nodes[new].tolist()
                    todo += new.tolist()
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([
                pa.array([*nodes[hit].tolist(), *map(int, a)], pa.int64()), pa.array([None] * len(hit) + b, pa.int64()),
                pa.array([*links[hit].tolist(), *[0] * len(a)], pa.int64())], ["node", "other", "links"])

    return run


def _shingled(wanted: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return wanted.mapInArrow(run, "node long, shingles binary")


def _blocks(groups: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(node, rep, copies, comp, block, others): a group of up to BLOCK documents is one block. A larger one is cut by bands
    of set size, a band into blocks by a hash. Sets that are alike by the threshold are in one band or in two that adjoin,
    so a block meets those of its own band and of the bands beside it."""
    member = groups.join(reps.select("node", "rep", "copies", "size"), "node").where("rep is not null")
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(1 / threshold * (1 + 1e-9)))).cast("long")
    banded = member.withColumn("band", band)
    cut = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    bands = banded.groupBy("root", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    plans = bands.groupBy("root").agg(
        (F.sum("n") <= BLOCK).alias("few"), (F.sum("shingles") <= BLOCK_SHINGLES).alias("light"), F.map_from_entries(F.collect_list(F.struct("band", cut.alias("cut")))).alias("cuts"))
    plans = materialize(plans.select("root", (F.col("few") & F.col("light")).alias("single"), "cuts"), "block-plans")
    of = lambda b: F.transform(F.sequence(F.lit(0).cast("long"), F.try_element_at("cuts", b) - 1), lambda i: b * (1 << 32) + i)
    near = F.flatten(F.array(*[F.when(F.try_element_at("cuts", F.col("band") + d).isNotNull(), of(F.col("band") + d)).otherwise(F.array().cast("array<bigint>")) for d in (-1, 0, 1)]))
    own = F.col("band") * (1 << 32) + F.pmod(F.xxhash64("node"), F.try_element_at("cuts", F.col("band")))
    zero = F.lit(0).cast("long")
    return join_checked(banded, plans, ["root"], "inner").select(
        "node", "rep", "copies", F.col("root").alias("comp"), F.when(F.col("single"), zero).otherwise(own).alias("block"), F.when(F.col("single"), F.array(zero)).otherwise(near).alias("others"))


def join_documents(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text", probes: int = PROBES, least_recall: float = LEAST_RECALL,
    report: Callable[[Forest], None] | None = None,
) -> DataFrame:
    """(doc_id, class_id, n_links, copy_of) of each row of docs.

    A link joins two documents whose sets of five-word shingles have a Jaccard similarity of at least ``threshold``;
    documents with equal sets are linked, those without words with each other alone. ``class_id`` is the least id that
    links lead to, ``copy_of`` the least id with an equal set. Copies count as links, each row one. Nulls are texts
    without words; a class with no id at all has a null class_id, and is linked to its copies alone. Very long texts are
    whole sets, in blocks of few documents. An empty table gives no rows; columns beside the two named are not read.
    ``report`` is told how far prefixes were shortened and what recall was measured.
    """
    spark = docs.sparkSession
    signed = materialize(signatures(docs, doc_id, text), "signatures")
    reps = materialize(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig")), "representatives")
    groups, forest = similar_groups(reps, recall, threshold, probes, least_recall)
    if report:
        report(forest)
    placed = materialize(_blocks(groups, reps, threshold), "placed")
    bare = docs.select(col(doc_id).cast("long").alias("rep"), col(text).alias("text"))
    wanted = join_checked(bare, placed.select("rep").distinct(), ["rep"], "left_semi")
    shingled = _shingled(wanted, SHINGLE).join(placed, "node")
    dealt = shingled.withColumn("other", F.explode("others")).select("comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "block", "copies", "shingles")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["comp", "lo", "hi"]
    verified = materialize(dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_verify(threshold), "node long, other long, links long"), "links")
    links = verified.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(verified.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = materialize(reps.select("node", "rep", "copies").join(links, "node", "left").join(roots, "node", "left"), "linked")
    ids = known.where("root is not null").groupBy("root").agg(F.min("rep").alias("class_id"))
    near = known.where("root is not null").join(ids, "root").select("node", "rep", "copies", "links", "class_id")
    alone = known.where("root is null").select("node", "rep", "copies", "links", F.col("rep").alias("class_id"))
    classes = near.unionByName(alone).select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("rep").alias("copy_of"))
    return signed.select("doc_id", "node").join(classes, "node").select("doc_id", "class_id", "n_links", "copy_of")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those whose class has a smaller id. Rows of one id are one document and share its fate; rows without
    an id stay. Texts without a word (null, empty) are one class; very long texts are compared whole; an empty table stays empty, other
    columns stay."""
    gone = join_documents(docs, threshold, doc_id=doc_id, text=text).where("doc_id > class_id").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = materialize(gone, "near-duplicates")
    (key,) = fresh(docs, "gone_id")
    keyed = docs.withColumn(key, col(doc_id).cast("long"))
    return join_checked(keyed, gone.withColumnRenamed("gone_id", key), [key], "left_anti").select(*map(col, docs.columns))


#: The same rows by all shared shingles and a recursive search: DuckDB.
ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + {SHINGLE - 1}), ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - {SHINGLE - 1}))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y, common = nx.size AND common = ny.size AS equal
  FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 1000 * common >= {round(THRESHOLD * 1000)} * (nx.size + ny.size - common)
  UNION ALL
  SELECT a.doc_id, b.doc_id, true FROM w a JOIN w b ON len(a.words) = 0 AND len(b.words) = 0 AND a.doc_id <> b.doc_id),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM w
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
c AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY 1),
k AS (SELECT x AS doc_id, count(*) AS n_links, min(y) FILTER (WHERE equal) AS first_copy FROM links GROUP BY 1)
SELECT c.doc_id, c.class_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links, least(c.doc_id, coalesce(k.first_copy, c.doc_id)) AS copy_of
FROM c LEFT JOIN k USING (doc_id)
"""
