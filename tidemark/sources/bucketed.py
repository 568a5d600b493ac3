"""Parquet tables in buckets by a key: joins and groups by that key leave their rows where they are.

Spark keeps the buckets of a table in its catalog alone, so a session names the table anew by its folder, columns and buckets; the
folder holds nothing but the files, one a bucket and write.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_buckets(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> DataFrame:
    """The table in a folder that ``write_buckets`` has filled, with the same columns, key and number of buckets."""
    return spark.table(_named(spark, path, schema, key, buckets))


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Put rows into a new folder, hashed by ``key`` into files that are sorted by it. Rows without a key share a bucket."""
    name = _named(df.sparkSession, path, df.schema, key, buckets)
    df.repartition(buckets, key).sortWithinPartitions(key).write.insertInto(name)


def _named(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> str:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    name = f"buckets_{hashlib.sha256(f'{path} {columns} {key} {buckets}'.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name
