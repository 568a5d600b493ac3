"""Weighted rendezvous hashing of record keys over shards, in DataFrame functions alone.

Every record meets every shard with a hash of (key, shard); the shard with the least ``-ln(u) / weight`` wins. Whether a
record is in a shard depends on its key, that shard and the winner alone, so one more shard takes records only into
itself, about ``weight / total`` of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import col, fresh

#: Rows that one slot bucket should hold: the slots of a bucket are counted in one task.
SLOT_BUCKET_ROWS = 50_000
LEAST_BUCKETS = 16


def _cost(keys: Sequence[Column], shard: Column, weight: Column) -> Column:
    draw = (F.shiftrightunsigned(F.xxhash64(*keys, shard), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(draw) / weight


def rendezvous(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """Struct (cost, shard) of the winning shard, 0 to len(weights) - 1; a weight of 0 takes nothing.

    Null keys hash as absent: all records whose keys are all null share one shard.
    """
    open_shards = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not open_shards:
        raise ValueError("a shard with a positive weight is needed")
    table = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(w).alias("weight")) for i, w in open_shards])
    return F.array_min(F.transform(table, lambda s: F.struct(_cost(keys, s["shard"], s["weight"]).alias("cost"), s["shard"].alias("shard"))))


def grown(keys: Sequence[Column], winner: Column, shard: int, weight: float = 1.0) -> Column:
    """The shard once ``shard`` joins the others: it takes the record or the record stays."""
    return F.when(_cost(keys, F.lit(shard), F.lit(float(weight))) < winner["cost"], F.lit(shard)).otherwise(winner["shard"])


def assign_shards(df: DataFrame, keys: Sequence[str], weights: Sequence[float], shard: str = "shard", grown_shard: str | None = None) -> DataFrame:
    """df with the shard of each row, and with ``grown_shard`` the shard it would have if one of weight 1 were added.

    Computed columns replace columns of the same name. Equal keys (repeated rows, too) share a shard; an empty table
    gives an empty one.
    """
    (winner,) = fresh(df, "winner")
    cols = [col(k) for k in keys]
    out = df.withColumn(winner, rendezvous(cols, weights))
    extra = {grown_shard: grown(cols, F.col(winner), len(weights))} if grown_shard else {}
    return out.withColumns({shard: F.col(winner)["shard"], **extra}).drop(winner)


def number_slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without a gap, without one task per shard.

    A shard's rows are dealt into hash buckets of ``order``; buckets get their first slots from prefix sums of the bucket
    counts (a few numbers a shard), and rows are ranked inside a bucket alone. Ties in ``order`` are equal rows of the
    listed columns; they get neighbouring slots.
    """
    bucket, first, count, key = fresh(df, "slot_bucket", "first_slot", "bucket_rows", "shard_key")
    shards = df.select(F.count_distinct(col(shard)).alias("s"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(LEAST_BUCKETS, shards["n"] // (SLOT_BUCKET_ROWS * max(1, shards["s"])))
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(F.lit("slot"), *map(col, order)), F.lit(buckets)))
    counts = dealt.groupBy(col(shard).alias(key), F.col(bucket)).agg(F.count(F.lit(1)).alias(count))
    below = F.sum(count).over(_window([key], [bucket]).rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(key, bucket, F.coalesce(below, F.lit(0)).alias(first))
    ranked = dealt.withColumn(slot, F.row_number().over(_window([shard, bucket], order)).cast("long"))
    bases = bases.withColumnRenamed(bucket, f"{bucket}_of")
    joined = ranked.join(bases, (col(shard).eqNullSafe(F.col(key))) & (F.col(bucket) == F.col(f"{bucket}_of")), "left")
    return joined.withColumn(slot, F.col(slot) - 1 + F.col(first)).drop(bucket, f"{bucket}_of", first, key)


def _window(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*map(col, by)).orderBy(*map(col, order))


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder a shard, whole rows in it."""
    df.write.partitionBy(shard).parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 24, weights: Sequence[float] | None = None) -> DataFrame:
    """Documents with size, text_crc32, law, shard, slot and grown_shard; columns of docs with such names are replaced, all
    others are kept as they are.

    A null text has no bytes: size 8, crc 0. Very long texts only add to the size. Null ids all share a shard; repeated rows
    keep one slot each. An empty table gives an empty one.
    """
    weights = weights or [1.0] * n_shards
    text = col("text").cast("binary")
    sized = docs.withColumns({
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8,
        "text_crc32": F.coalesce(F.crc32(text), F.lit(0)).cast("long"),
        "law": F.lit("key"),
    })
    sharded = assign_shards(sized, ["doc_id"], weights, "shard", "grown_shard")
    return number_slots(sharded, "shard", ["doc_id", "text_crc32", "size"])
