"""Phrase collocations from depth-limited count tries.

1. A task reads its documents into runs of bounded length. A run becomes one count trie a language: level by level, nodes are
   the different (node above, word) pairs of the phrases of that length, with their counts. Words are numbered in byte
   order, so nodes come out sorted.
2. A trie is serialised in sorted order and cut by prefix range: ranges of a 32-bit hash of the language and the first two words
   of a phrase, so that a common first word spreads over all ranges. A piece has its own small dictionary.
3. Ranges are shuffled; the pieces of a range, one a run, are merged into one sorted trie. Phrases below the least count go, the
   total of each language stays.
4. A phrase's left parts are the nodes on the way to it, its right parts those that its suffix links lead to: joins on the
   part's words with the merged nodes, of which only frequent ones are needed, since a part is as frequent as the whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, col, join_checked, materialize, runs, text_parts

LONGEST = 3
LEAST = 10
#: A phrase is dropped if a longer one around it has this many in 100 of its occurrences.
COVERED = 50
TOP = 2_000
NO_LANG = "und"
#: Words that a run holds before its tries are cut, and bytes of text that a prefix range stands for.
RUN_WORDS, RANGE_BYTES = 2_000_000, 8 << 20
#: Rows of a language that a task ranks before the language's own ranking.
SALTS = 64
#: Occurrences up to 10^15 stay exact: a * a * 1000000 and l * r have at most 38 digits.
_COUNT = "decimal(15,0)"

_BREAKS = re.compile(rb"[.,;:!?\x0A-\x0D]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PIECES = "part int, lang string, depth int, words binary, ids binary, counts binary"
_NODES = "lang string, depth int, words array<string>, n long"


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, with an empty one between pieces."""
    out: list[bytes] = []
    for piece in _BREAKS.split(text.translate(_LOWER)):
        out += [w for w in piece.replace(b"\t", b" ").split(b" ") if w]
        out.append(b"")
    return out


def _cut(found: list[bytes], size: int) -> Iterator[list[bytes]]:
    """Parts of about ``size`` words, cut between pieces: no phrase crosses such a place."""
    at = 0
    while len(found) - at > size:
        to = found.index(b"", at + size - 1) + 1
        yield found[at:to]
        at = to
    yield found[at:]


def _packed(columns: list[np.ndarray], size: int) -> np.ndarray:
    """One integer a row that sorts as the columns do, one after another; ``size`` is above all their values."""
    def add(key: np.ndarray, column: np.ndarray) -> np.ndarray:
        if len(key) and (int(key.max()) + 1) * size >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1].astype("i8")
        return key * size + column

    return reduce(add, [c.astype("i8") for c in columns])


def _nodes(columns: list[np.ndarray], size: int, counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows in ascending order, with how often each stands there or the sum of its counts."""
    order = np.argsort(key := _packed(columns, size), kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, "i8")
    summed = np.add.reduceat(counts[order], first) if counts is not None and len(key) else np.diff(first, append=len(key))
    return [c[order[first]] for c in columns], summed.astype("i8")


def tries(ids: np.ndarray, size: int, longest: int) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """Nodes of each depth of a run's count trie. ids are word numbers in their order, 0 between pieces."""
    out, whole = [], ids != 0
    for depth in range(1, longest + 1):
        n = max(0, len(ids) - depth + 1)
        inside = reduce(np.logical_and, [whole[j : j + n] for j in range(depth)])
        at = np.flatnonzero(inside)
        out.append(_nodes([ids[at + j] for j in range(depth)], size))
    return out


def _prefix_hash(lang: str, crcs: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """32 bits of the language and of the first two words of each node."""
    h = np.full(len(columns[0]), zlib.crc32(lang.encode()), "u8")
    for c in columns[:2]:
        h = (h ^ crcs[c]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h & np.uint64(0xFFFFFFFF)


def _pieces(lang: str, vocabulary: dict[bytes, int], ids: np.ndarray, longest: int, parts: int) -> Iterator[tuple]:
    """A run's tries, serialised and cut by prefix range: words by number, in byte order, from 1."""
    used = np.unique(ids)
    every = list(vocabulary)
    words = sorted(every[i] for i in used if i)
    rank = {w: i for i, w in enumerate(words, 1)}
    to = np.zeros(len(every), "i8")
    for i in used:
        to[i] = rank.get(every[i], 0)
    crcs = np.array([0, *map(zlib.crc32, words)], "u8")
    for depth, (columns, counts) in enumerate(tries(to[ids], len(words) + 1, longest), 1):
        part = (_prefix_hash(lang, crcs, columns) * np.uint64(parts) >> np.uint64(32)).astype("i4")
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            own = order[edges[p] : edges[p + 1]]
            local, inverse = np.unique(np.stack([c[own] for c in columns]), return_inverse=True)
            spelled = b" ".join(words[i - 1] for i in local)
            yield int(p), lang, depth, spelled, inverse.astype("<u4").tobytes(), counts[own].astype("<u4" if counts[own].max() < 1 << 32 else "<u8").tobytes()


def shard_tries(docs: DataFrame, parts: int, longest: int = LONGEST, lang: str = "lang", text: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """Serialised tries of all runs, cut into ``parts`` prefix ranges."""
    arrow_batches(docs.sparkSession)
    names = [c.split()[0] for c in _PIECES.split(", ")]
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("depth", pa.int32()), ("words", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {b"": 0}
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for own in sorted(held):
                rows = list(_pieces(own, number, np.concatenate(held[own]), longest, parts))
                for i in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + 256]], schema)

        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for found in _cut(tokens(data or b""), run_words):
                    for w in found:
                        if w not in number:
                            number[w] = len(number)
                    held.setdefault(own, []).append(np.fromiter(map(number.__getitem__, found), "i8", len(found)))
                    size += len(found)
                    if size >= run_words:
                        yield from flush()
                        number, held, size = {b"": 0}, {}, 0
        yield from flush()

    return docs.select(F.coalesce(col(lang).cast("string"), F.lit(NO_LANG)), col(text)).mapInArrow(run, _PIECES)


def _merged(table: pa.Table, least: int) -> Iterator[tuple]:
    """Nodes of one prefix range over all runs: those of at least ``least`` occurrences, and each language's words at depth 0."""
    groups: dict[tuple[str, int], list[tuple]] = {}
    for lang, depth, *piece in zip(*(table.column(c).to_pylist() for c in ("lang", "depth", "words", "ids", "counts")), strict=True):
        groups.setdefault((lang, depth), []).append(piece)
    for (lang, depth), pieces in sorted(groups.items()):
        dictionary: dict[bytes, int] = {}
        columns, counts = [], []
        for spelled, ids, many in pieces:
            words = spelled.split(b" ")
            for w in words:
                if w not in dictionary:
                    dictionary[w] = len(dictionary)
            to = np.fromiter(map(dictionary.__getitem__, words), "i8", len(words))
            own = to[np.frombuffer(ids, "<u4")].reshape(depth, -1)
            columns.append(own)
            counts.append(np.frombuffer(many, "<u4" if len(many) == 4 * own.shape[1] else "<u8").astype("i8"))
        nodes, total = _nodes(list(np.concatenate(columns, 1)), len(dictionary), np.concatenate(counts))
        if depth == 1:
            yield lang, 0, [], int(total.sum())
        often, words = np.flatnonzero(total >= least), list(dictionary)
        for i in often:
            yield lang, depth, [words[c[i]].decode("utf-8", "replace") for c in nodes], int(total[i])


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, lang: str = "lang", text: str = "text", run_words: int = RUN_WORDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, depth, words, n), written: every phrase of 1 to ``longest`` words with ``least`` occurrences or more, and at depth
    0 the number of all words, for each range a row."""
    parts = text_parts(docs, text, range_bytes)
    cut = shard_tries(docs, parts, longest, lang, text, run_words)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, schema = [c.split()[0] for c in _NODES.split(", ")], pa.schema([("lang", pa.string()), ("depth", pa.int32()), ("words", pa.list_(pa.string())), ("n", pa.int64())])
        for table in runs(batches, ["part"]):
            rows = [dict(zip(names, r, strict=True)) for r in _merged(table, least)]
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], schema)

    dealt = cut.repartitionById(parts, "part").sortWithinPartitions("part", "lang", "depth")
    return materialize(dealt.mapInArrow(merge, _NODES), "phrases")


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int | None = TOP, lang: str = "lang", text: str = "text",
    run_words: int = RUN_WORDS, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of each language, from 1.

    A phrase has 2 to ``longest`` words and occurs a times, ``least`` at least, among the n words of its language. Its score is the
    least of floor(1000000 a a / (l r)) over the cuts into a left part, found l times, and a right one, found r times; of equal cuts the first
    counts. A phrase inside a longer one that has ``covered`` in 100 of its occurrences is left out. Ties in the score go by a, then by the
    bytes of the phrase. ``top`` bounds each language's report; None gives all.

    A null or empty text has no words; a null language is ``und``; repeated rows count each; very long texts are whole: runs end between
    pieces, so no phrase is lost, and only a single piece can make a run longer than ``run_words``. An empty table gives no rows; other columns are not read.
    """
    nodes = frequent_phrases(docs, longest, least, lang, text, run_words, range_bytes)
    totals = materialize(nodes.where("depth = 0").groupBy("lang").agg(F.sum("n").alias("n")), "words")
    parts = materialize(nodes.where("depth > 0").select("lang", _joined(F.col("words")).alias("part"), F.col("n").alias("found")), "parts")
    phrases = nodes.where("depth > 1")
    slice_ = lambda at, n: _joined(F.slice("words", at, n))
    whole = F.col("depth")
    # Longer phrases around each: the runs of 2 words or more in it but itself.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), whole - 1), lambda n: F.transform(F.sequence(F.lit(1), whole - n + 1), lambda at: slice_(at, n))))
    around = phrases.where("depth > 2").select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = phrases.select("lang", _joined(F.col("words")).alias("phrase"), "depth", "words", F.col("n").alias("a")).join(around, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")
    cut = kept.select("lang", "phrase", "a", "words", whole, F.explode(F.sequence(F.lit(1), whole - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", slice_(F.lit(1), F.col("k")).alias("left"), slice_(F.col("k") + 1, whole - F.col("k")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        cut = join_checked(cut, parts.select("lang", F.col("part").alias(side), F.col("found").alias(count)), ["lang", side], "inner")
    exact = lambda c: F.col(c).cast(_COUNT)
    cut = cut.withColumns({"top": F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a")), "under": exact("l") * exact("r")}).withColumn("score", F.expr("top div under"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = join_checked(best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), totals, ["lang"], "inner")
    if top is not None:  # a language's rows are thinned in many tasks before one ranks what is left
        scored = _first(scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))), ["lang", "salt"], top).drop("salt", "rank")
    return _first(scored, ["lang"], top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _first(rows: DataFrame, by: list[str], top: int | None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    out = rows.withColumn("rank", rank)
    return out if top is None else out.where(F.col("rank") <= top)


#: The same in DuckDB.
ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY 1),
grams AS (
  SELECT lang, d, words[i : i + d - 1] AS p FROM (SELECT lang, words, d, unnest(range(1, len(words) - d + 2)) AS i FROM w, range(1, {LONGEST} + 1) r(d) WHERE len(words) >= d)),
f AS (SELECT lang, d, p, count(*) AS f FROM grams GROUP BY ALL),
c AS (SELECT lang, d, p, f AS a FROM f WHERE d > 1 AND f >= {LEAST}),
inner_ AS (
  SELECT lang, p[i : i + m - 1] AS p, max(a) AS longer
  FROM (SELECT lang, p, a, m, unnest(range(1, d - m + 2)) AS i FROM c, range(2, {LONGEST}) r(m) WHERE m < d) GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, p) WHERE longer IS NULL OR 100 * longer < {COVERED} * a),
cuts AS (
  SELECT k.lang, k.p, k.a, s AS k, l.f AS l, r.f AS r, (1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, d)) AS s FROM kept) k JOIN f l ON l.lang = k.lang AND l.p = k.p[1 : s] JOIN f r ON r.lang = k.lang AND r.p = k.p[s + 1 :]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best JOIN n USING (lang) QUALIFY rank <= {TOP}
"""
