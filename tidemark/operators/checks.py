"""Structural rules as queries: each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schemas import CALENDAR, FOREVER


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def dangling(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose key the parent lacks."""
    return df.join(parent.select(key), key, "left_anti")


def overlapping(history: DataFrame, key: str) -> DataFrame:
    """Versions that begin before the one before them has ended."""
    before = F.max("valid_to").over(Window.partitionBy(key).orderBy("valid_from").rowsBetween(Window.unboundedPreceding, -1))
    return history.withColumn("ended", before).where("ended > valid_from")


def misdated(history: DataFrame) -> DataFrame:
    """Versions that end before they begin, or whose flag and end don't agree."""
    last = F.col("valid_to") == F.lit(FOREVER).cast("date")
    return history.where((F.col("valid_from") >= F.col("valid_to")) | (F.col("is_current") != last))


def many_current(history: DataFrame, key: str) -> DataFrame:
    return repeated(history.where("is_current"), key)


def bad_facts(facts: DataFrame, calendar: tuple[str, str] = CALENDAR) -> DataFrame:
    """Facts of no positive price, or of a day outside the calendar."""
    low, high = (F.lit(d).cast("date") for d in calendar)
    return facts.where((F.col("sale_price") <= 0) | ~F.col("collection_date").between(low, high))


def broken(stations: DataFrame, facts: DataFrame, brands: DataFrame, cities: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """Every rule of the model by name."""
    return {
        "one fact a grain": repeated(facts, "cnpj", "product_key", "collection_date"),
        "facts have versions": dangling(facts, stations, "station_key"),
        "facts are plausible": bad_facts(facts),
        "versions don't overlap": overlapping(stations, "cnpj"),
        "versions are dated well": misdated(stations),
        "one current version": many_current(stations, "cnpj"),
        "one key a version": repeated(stations, "station_key"),
        "14 digits": stations.where(~F.col("cnpj").rlike("^[0-9]{14}$")),
        "versions have brands": dangling(stations, brands, "brand_key"),
        "versions have cities": dangling(stations, cities, "city_key"),
        "aliases have brands": dangling(aliases, brands, "brand_key"),
        "one key a brand": repeated(brands, "brand_name"),
        "one key a city": repeated(cities, "city_name", "uf"),
    }


def require(rules: dict[str, DataFrame]) -> None:
    """Raise on the first rule that a row breaks."""
    for name, rows in rules.items():
        if not rows.isEmpty():
            raise ValueError(f"rule broken: {name}: {rows.limit(3).collect()}")
