"""Importance resampling: documents drawn by how much likelier a target corpus makes their words.

1. Documents become inverted postings. A task cuts its documents into blocks of bounded text; a block gives one row for
   each bucket of features that it has, with the numbers of its documents and their counts as flat arrays, and one row that
   lists its documents. Postings are written once, so all later steps see the same blocks.
2. The bucket totals of both corpora are grouped together by bucket, and each bucket's gain comes from its own group.
3. Postings are shuffled by bucket and meet their gain there. A bucket with more than a partition's share of the postings
   is split by block, and its gain copied once a split: at most buckets + partitions rows.
4. What a posting adds goes to its block, where it is added up by document. A block's postings are bounded by its text.
5. Scores are sorted over all partitions; ranks follow from the partitions' row counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_batches, col, join_checked, materialize

BUCKETS = 10_000
#: Words in the longest run that is a feature.
LONGEST = 1
MIN_WORDS = 20
SHARE, SEED = 10, 2024
#: A block ends once it has so many bytes of text or documents; document numbers in it fit 16 bits.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 1 << 16
#: Entries and bytes a word of the memo of buckets.
MEMO_WORDS, MEMO_WORD_BYTES = 200_000, 64
#: The bucket of the row that lists a block's documents.
LISTING = -1

#: Every byte that no word has becomes a space, A-Z become a-z; bytes of code points beyond ASCII stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class _Buckets(dict):
    """Buckets of features, worked out when first asked for. Long ones aren't kept, and all are dropped when it is full."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(feature) <= MEMO_WORD_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[feature] = bucket
        return bucket


def features(text: bytes, longest: int = LONGEST) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of 1 to ``longest`` of them joined by a space."""
    words = text.translate(_WORDS).split()
    found = list(words)
    for n in range(2, longest + 1):
        found += map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return len(words), found


def _block(number: int, held: list[tuple], ids: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    """The rows of a block; ``held`` has text key, words and buckets of each document."""
    sizes = np.array([len(found) for *_, found in held], "i8")
    place = np.repeat(np.arange(len(held), dtype="u8"), sizes)
    cells, counts = np.unique(np.concatenate([found for *_, found in held]).astype("u8") << np.uint64(16) | place, return_counts=True)
    own, docs, counts = (cells >> np.uint64(16)).astype("i4"), (cells & np.uint64(0xFFFF)).astype("<u2"), counts.astype("<u4")
    edges = np.flatnonzero(np.diff(own, prepend=-1, append=-1)) if len(own) else np.zeros(1, "i8")
    n = len(edges) - 1
    cut = lambda a: [a[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
    totals = np.add.reduceat(counts, edges[:-1], dtype="i8") if n else np.zeros(0, "i8")
    one = lambda values, kind: pa.array([None] * n + [values], pa.list_(kind))
    arrays = [
        pa.array([*own[edges[:-1]].tolist(), LISTING] if n else [LISTING], pa.int32()), pa.array([number] * (n + 1), pa.int64()),
        pa.array([*cut(docs), None], pa.binary()), pa.array([*cut(counts), None], pa.binary()), pa.array([*totals.tolist(), None], pa.int64()),
        pa.concat_arrays([pa.nulls(n, pa.list_(ids.type)), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]),
        one([k for k, *_ in held], pa.int64()), one([w for _, w, _ in held], pa.int64()), one(sizes.tolist(), pa.int64()),
    ]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def postings(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(bucket, block, docs, counts, total, and of LISTING rows ids, keys, words, features) of all documents.

    A block is numbered by its task and its turn there, so write the postings before they are read twice."""
    spark = docs.sparkSession
    arrow_batches(spark)
    kind = docs.schema[doc_id].dataType
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("bucket", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("docs", T.BinaryType()), T.StructField("counts", T.BinaryType()),
        T.StructField("total", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("keys", longs), T.StructField("words", longs), T.StructField("features", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, at = _Buckets(buckets), TaskContext.get().partitionId() << 33
        held, ids, size = [], [], 0

        def flush() -> pa.RecordBatch:
            every = pa.concat_arrays(ids)
            item = every.type
            own = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()), ("ids", pa.list_(item)), *((k, pa.list_(pa.int64())) for k in ("keys", "words", "features"))])
            return _block(at, held, every, own)

        for batch in batches:
            first = 0
            for i, (data, key) in enumerate(zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words, found = features(data or b"", longest)
                held.append((key, words, np.fromiter(map(memo.__getitem__, found), "i4", len(found))))
                size += len(data or b"")
                if size >= block_bytes or len(held) == BLOCK_DOCS:
                    ids.append(batch.column(0).slice(first, i + 1 - first))
                    yield flush()
                    held, ids, size, at, first = [], [], 0, at + 1, i + 1
            if first < batch.num_rows:
                ids.append(batch.column(0).slice(first))
        if held:
            yield flush()

    return docs.select(col(doc_id).alias("id"), col(text).alias("text"), F.xxhash64(col(text)).alias("key")).mapInArrow(run, schema)


def _totals(found: DataFrame) -> DataFrame:
    return found.where(F.col("bucket") != LISTING).groupBy("bucket").agg(F.sum("total").alias("n"), F.sum(F.octet_length("docs").cast("long")).alias("size"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain, splits) of the source's buckets, written: at most ``buckets`` rows."""
    spark, zero = source.sparkSession, F.lit(0).cast("long")
    both = _totals(source).withColumn("t", zero).unionByName(_totals(target).select("bucket", zero.alias("n"), zero.alias("size"), F.col("n").alias("t")))
    counted = materialize(both.groupBy("bucket").agg(F.sum("n").alias("s"), F.sum("t").alias("t"), F.sum("size").alias("size")), "buckets")
    total = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("s", "t", "size")]).first()
    real = lambda c: F.col(c).cast("double") + 1
    odds = real("t") * F.lit(float(total["s"] + buckets)) / (real("s") * F.lit(float(total["t"] + buckets)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = 1 + F.floor(F.col("size") * F.lit(parts) / F.lit(max(1, total["size"])))
    return materialize(counted.where("s > 0").select("bucket", F.floor(1000 * F.log(odds)).alias("gain"), splits.cast("int").alias("splits")), "gains")


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, key, n_words, n_features, weight, block, place) of every document, written: the weight is the floored mean of its features' gains,
    0 without a feature; key is the text's hash, block and place tell rows apart."""
    spark = docs.sparkSession
    source = materialize(postings(docs, buckets, longest, doc_id, text, block_bytes), "postings")
    gains = bucket_gains(source, postings(target.select(F.lit(0).alias("id"), col(text).alias("text")), buckets, longest, "id", "text", block_bytes), buckets)
    # Buckets that are split: no more than there are partitions, since each has more than a partition's share.
    split = gains.where("splits > 1").select("bucket", "splits")
    dealt = source.where(F.col("bucket") != LISTING).select("bucket", "block", "docs", "counts").join(F.broadcast(split), "bucket", "left")
    dealt = dealt.withColumn("split", F.pmod(F.xxhash64("block"), F.coalesce("splits", F.lit(1))).cast("int")).drop("splits")
    copies = gains.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")
    added = dealt.join(copies.hint("merge"), ["bucket", "split"]).select("block", "docs", "counts", "gain")
    listed = source.where(F.col("bucket") == LISTING).select("block", "ids", "keys", "words", "features")
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(n, T.LongType()) for n in ("key", "n_words", "n_features", "weight", "block", "place"))])

    def reduce(table: pa.Table) -> pa.Table:
        at = table.column("ids").is_valid().to_pylist().index(True)
        own = {c: table.column(c)[at].values for c in ("ids", "keys", "words", "features")}
        total, many = np.zeros(len(own["ids"]), "i8"), np.asarray(own["features"])
        for where, counts, gain in zip(*(table.column(c).to_pylist() for c in ("docs", "counts", "gain")), strict=True):
            if where is not None:
                total[np.frombuffer(where, "<u2")] += np.frombuffer(counts, "<u4").astype("i8") * gain
        weight = np.where(many > 0, total // np.maximum(many, 1), 0)
        block = pa.array([table.column("block")[0].as_py()] * len(total), pa.int64())
        return pa.table([own["ids"], own["keys"], own["words"], own["features"], pa.array(weight), block, pa.array(np.arange(len(total), dtype="i8"))], names=schema.names)

    return materialize(added.unionByName(listed, allowMissingColumns=True).groupBy("block").applyInArrow(reduce, schema), "weights")


def ranked(rows: DataFrame, *order, rank: str = "rank") -> DataFrame:
    """Written rows with their places, from 1, in an order that no two rows share: sorted over all partitions, the places of
    a partition's rows follow those of the partitions before it."""
    place = "place_in_order"
    laid = materialize(rows.orderBy(*order).withColumn(place, F.monotonically_increasing_id()), "in-order")
    part = F.shiftright(F.col(place), 33)
    sizes = laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = materialize(sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")), "parts")
    own = join_checked(laid.withColumn("part", part), before, ["part"], "inner")
    return own.withColumn(rank, F.col("before") + F.col(place).bitwiseAND((1 << 33) - 1) + 1).drop("part", "before", place)


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST,
    doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, key, n_words, n_features, weight, score, rank) of every document; those with a rank are drawn, the best first.

    Drawn are ``share`` in 100 of the documents with ``min_words`` words, by weight plus noise of the id. Equal scores go by
    the id (null first), equal ids by the text's hash; equal rows take neighbouring ranks. Null and empty texts have no word, weight 0
    and no rank. Very long texts count whole, as blocks of their own. An empty table gives no rows; with an empty target all
    counts of it are 0. Other columns are not read.
    """
    weights = weigh(docs, target, buckets, longest, doc_id, text, block_bytes)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    share_of = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = weights.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(share_of))))
    fit = F.col("n_words") >= min_words
    most = share * weights.where(fit).count() // 100
    placed = ranked(scored.where(fit), F.desc("score"), F.asc_nulls_first("id"), "key", "block", "place")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return placed.unionByName(scored.where(~fit), allowMissingColumns=True).drop("block", "place")


def drawn_documents(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents drawn, with all their columns. Rows of one id and text are drawn together if one of them is."""
    drawn = resample(docs, target, doc_id=doc_id, text=text, **options).where("rank is not null").select(F.col("id").alias("drawn_id"), F.col("key").alias("drawn_key")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own = dict(zip(docs.columns, names, strict=True))
    same = F.col(own[doc_id]).eqNullSafe(F.col("drawn_id")) & (F.xxhash64(own[text]) == F.col("drawn_key"))
    return plain.join(drawn, same, "left_semi").toDF(*docs.columns)


#: The same in DuckDB. CRC-32 is worked out a byte at a time for each different word, by the table of its polynomial.
ORACLE = f"""
WITH polynomial AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([CAST(i AS BIGINT)] || [CAST(k AS BIGINT) FOR k IN range(8)], lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c
    FROM range(256) r(i))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
dw AS (SELECT doc_id, unnest(words) AS w FROM d), bw AS (SELECT unnest(words) AS w FROM b),
hexed AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
coded AS (
  SELECT w, xor(list_reduce([4294967295] || [CAST(16 * (instr('0123456789ABCDEF', x[2 * i - 1]) - 1) + instr('0123456789ABCDEF', x[2 * i]) - 1 AS BIGINT) FOR i IN range(1, len(x) // 2 + 1)],
    lambda a, v: xor(a // 256, t[xor(a, v) % 256 + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM hexed, polynomial),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN coded USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM bw JOIN coded USING (w) GROUP BY 1),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS}.0::DOUBLE)
    / ((s.n + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS}.0::DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM dw JOIN coded USING (w) JOIN gains USING (bucket) GROUP BY 1),
hashed AS (
  SELECT doc_id, list_reduce([0::BIGINT] || [CAST(instr('0123456789abcdef', sha256('{SEED}:' || doc_id)[i]) - 1 AS BIGINT) FOR i IN range(1, 9)], lambda a, v: 16 * a + v) AS h FROM documents),
scored AS (
  SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id) JOIN hashed USING (doc_id)),
placed AS (
  SELECT *, CASE WHEN n_features >= {MIN_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) END AS turn,
    count(*) FILTER (WHERE n_features >= {MIN_WORDS}) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN turn <= {SHARE} * fit // 100 THEN turn END AS rank FROM placed
"""
