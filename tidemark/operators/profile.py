"""Profiles of a source: what its columns hold, whether its grain is one, and how its entities move."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import week_key
from tidemark.operators.history import one_per


def columns(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(column, rows, missing, distinct, least, highest) of each column, blank text counting as missing: one pass."""
    names = list(names or df.columns)
    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for c in names:
        text = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
        aggregates += [F.count_if(text.isNull()).alias(f"{c}|missing"), F.count_distinct(text).alias(f"{c}|distinct"), F.min(text).alias(f"{c}|least"), F.max(text).alias(f"{c}|highest")]
    one = df.agg(*aggregates)
    fields = [F.struct(F.lit(c).alias("column"), F.col("rows"), *[F.col(f"`{c}|{k}`").alias(k) for k in ("missing", "distinct", "least", "highest")]) for c in names]
    return one.select(F.explode(F.array(*fields)).alias("c")).select("c.*")


def histogram(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("rows"))


def weekdays(df: DataFrame, day: str) -> DataFrame:
    return histogram(df, F.extract(F.lit("DAYOFWEEK_ISO"), F.col(day)).cast("int"), "iso_day_of_week")


def months(df: DataFrame, day: str) -> DataFrame:
    return histogram(df, F.trunc(day, "month"), "month_start_date")


def grain(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Groups that repeat by day and by survey week, rows beyond the first, and groups whose values differ."""
    def by(name: str, at: Column) -> DataFrame:
        groups = df.groupBy(*keys, at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        return groups.agg(
            F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("surplus_rows"),
            F.count_if(F.col("low") < F.col("high")).alias("divergent")).select(F.lit(name).alias("grain"), "*")

    return by("day", F.col(day).cast("date")).unionByName(by("week", week_key(F.col(day))))


def duplicates(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Each repeated group with its rows, different values, and the gap between the extremes."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(value).alias("values"), (F.max(value) - F.min(value)).alias("gap")).where("rows > 1")


def gap_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    gap = F.col("gap").cast("double")
    return duplicates(df, keys, value).agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(gap == 0).alias("identical"), F.round(F.min(F.when(gap > 0, gap)), 4).alias("least_gap"),
        F.round(F.percentile(F.when(gap > 0, gap), 0.5), 4).alias("median_gap"), F.round(F.max(gap), 4).alias("greatest_gap"))


def in_many(df: DataFrame, key: str, place: str) -> DataFrame:
    """Keys that stand in more than one place."""
    return df.groupBy(key).agg(F.count_distinct(place).alias("places")).where("places > 1")


def dominant(df: DataFrame, key: str, value: str) -> DataFrame:
    """The value that a key has most often; of several, the least."""
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return one_per(counted, [key], [-F.col("n"), value]).select(key, value)


def transitions(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """(before, after, keys): how many keys of both inputs went from one dominant value to another."""
    a = dominant(first, key, value).withColumnRenamed(value, "before")
    b = dominant(second, key, value).withColumnRenamed(value, "after")
    return a.join(b, key).groupBy("before", "after").agg(F.count(F.lit(1)).alias("keys"))


def attribute_changes(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """(attribute, keys, changing): of how many keys an attribute has more than one value."""
    per = df.groupBy(key).agg(*[F.count_distinct(a).alias(a) for a in attributes])
    one = per.agg(F.count(F.lit(1)).alias("keys"), *[F.count_if(F.col(a) > 1).alias(a) for a in attributes])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), "keys", F.col(a).alias("changing")) for a in attributes])).alias("r")).select("r.*")


def missing_fields(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Of the rows without a key, how many lack each field."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    return df.where(blank(key)).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(blank(f)).alias(f) for f in fields])
