"""Shared plumbing of the text operators: shared scratch tables, size-checked joins, range bounds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.storage import delete, shared_dir

#: Rows and bytes of the small side up to which a join broadcasts it; beyond, the join shuffles both sides.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 32 << 20
#: Bytes of one Arrow batch at most (one row at least), and of the texts that a map works on at once.
BATCH_BYTES, SLICE_BYTES = 4 << 20, 1 << 20

#: Scratch folders that this process has named, oldest first.
_named: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    _named.append(f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}")
    return _named[-1]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """A point in time for ``discard_scratch``."""
    return len(_named)


def discard_scratch(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete the scratch folders named after ``since`` but those that ``keep`` reads; the number deleted.

    Results that are still lazy read such folders, so write them first."""
    needed, gone = keep.inputFiles() if keep is not None else [], []
    for path in _named[since:]:
        folder = path.rpartition("/")[2]  # no two folders share a name, however their file system spells the path
        if not any(f"/{folder}/" in f for f in needed):
            delete(spark, path)
            gone.append(path)
    _named[since:] = [p for p in _named[since:] if p not in gone]
    return len(gone)


def arrow_batches(spark: SparkSession) -> None:
    """Bound the bytes that one Arrow batch carries to a Python worker: the same bound for all plans of a session."""
    if str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) != str(BATCH_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of about ``size`` bytes of texts, a text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8"))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, to
        at = to


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def append_columns(df: DataFrame, run: Callable, added: list[T.StructField]) -> DataFrame:
    """df with more columns. ``run`` takes Arrow batches and yields, for each batch, the batch and the arrays to append.

    Columns go through under plain names, since an Arrow map takes no names with dots."""
    names = [f"c{i}" for i in range(len(df.columns))]
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields, strict=True)), *(T.StructField(f"a{i}", f.dataType) for i, f in enumerate(added))])

    def appended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, arrays in run(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema.names)

    return df.toDF(*names).mapInArrow(appended, schema).toDF(*df.columns, *(f.name for f in added))


def _fits(small: DataFrame, rows: int) -> bool:
    """Whether a written table may be broadcast: few rows, and few bytes in columns of any width."""
    if small.limit(rows + 1).count() > rows:
        return False
    wide = [F.coalesce(F.octet_length(col(f.name)), F.lit(0)) for f in small.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    return not wide or (small.agg(F.sum(sum(wide, F.lit(0).cast("long"))).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES


def _spread(df: DataFrame, salts: int) -> Column:
    """A salt that a repeated task deals alike: a hash of the whole row. Rows that are equal in all columns share one."""
    return F.pmod(F.xxhash64(*[col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))], F.lit("salt")), F.lit(salts))


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str, salts: int = 16, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a small, already written table to a big one.

    The small side is counted. Up to ``rows`` (and BROADCAST_BYTES) it is broadcast. Beyond, both sides shuffle and the
    key is salted: every row of the small side is copied ``salts`` times, so a hot key of the big side spreads over tasks.
    ``how`` may be inner, left, left_semi or left_anti, seen from the big side.
    """
    if _fits(small, rows):
        return big.join(F.broadcast(small), on, how)
    (salt,) = fresh(big, "salt")
    dealt = big.withColumn(salt, _spread(big, salts))
    copied = small.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copied, [*on, salt], how).drop(salt)


#: Code points of a text that the bounds of ranges know.
HEAD = 32


def text_parts(df: DataFrame, text: str, size: int, most: int | None = None) -> int:
    """Partitions of about ``size`` bytes of texts, not fewer than the session's shuffle partitions; ``most`` makes them larger instead of more."""
    total = df.agg(F.sum(F.octet_length(col(text)).cast("long")).alias("n")).first()["n"] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // size))
    return parts if most is None else min(parts, most)


def range_bounds(df: DataFrame, name: str, text: str, parts: int, rows: int = 100) -> list[tuple[int, str]]:
    """Up to parts - 1 ascending cut points (integer, head of text), from a sample of about ``rows`` rows a part.

    The sample is cut into ranges by Spark, and the driver gets the least row of each: ``parts`` rows, of which MOST_PARTS bounds the number.
    The cut points place rows and decide about balance alone; results don't depend on them."""
    n = df.count()
    if parts <= 1 or not n:
        return []
    keys = df.select(col(name).alias("k"), F.coalesce(F.substring(col(text), 1, HEAD), F.lit("")).alias("t")).where("k is not null")
    share = min(1.0, rows * parts / n)
    picked = materialize(keys if share == 1.0 else keys.sample(share, 11), "bounds")
    heads = picked.repartitionByRange(parts, "k", "t").groupBy(F.spark_partition_id()).agg(F.min(F.struct("k", "t")).alias("head")).select("head.*").collect()
    return sorted((r["k"], r["t"]) for r in heads)[1:]


#: Ranges whose bounds a plan and the driver can carry.
MOST_PARTS = 50_000


def range_part(name: str, text: str, bounds: list[tuple[int, str]]) -> Column:
    """How many cut points lie at or below (value, text): equal rows share a part, parts ascend. Nulls are in part 0.

    A binary search over two array literals: the expression is of one size, however many bounds there are."""
    if not bounds:
        return F.lit(0)
    n = len(bounds)
    keys = F.split(F.lit(",".join(str(k) for k, _ in bounds)), ",").cast("array<bigint>")
    heads = F.split(F.lit(",".join(t.encode().hex() for _, t in bounds)), ",")
    key, head = col(name), F.lower(F.hex(F.encode(F.coalesce(F.substring(col(text), 1, HEAD), F.lit("")), "utf-8")))
    reached = lambda i: (F.get(keys, i) < key) | ((F.get(keys, i) == key) & (F.get(heads, i) <= head))
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & reached(at + step - 1), at + step).otherwise(at))
    return F.when(key.isNull(), F.lit(0)).otherwise(found)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut sorted Arrow batches into tables of equal keys. A key that crosses batches comes as one table."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*cols, strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i] == rows[start]:
                continue
            piece = batch.slice(start, i - start)
            if held and held_key != rows[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
            held_key = rows[start]
            start = i
    if held:
        yield pa.Table.from_batches(held)
