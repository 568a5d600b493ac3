"""The weekly rollup: one row a survey week, city and product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import week_key, week_start
from tidemark.functions.prices import price, price_percentile


def weekly_rollup(facts: DataFrame, stations: DataFrame) -> DataFrame:
    """Observations, stations (versions of one), exact percentiles and extremes of the prices.

    City comes from the version in force on the day, which the fact already points to. One shuffle, on the group.
    """
    day = F.col("collection_date")
    placed = facts.join(stations.select("station_key", "city_key"), "station_key")
    grouped = placed.groupBy(week_key(day).alias("survey_week_key"), week_start(day).alias("week_start_date"), "city_key", "product_key")
    return grouped.agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct("station_key").alias("stations"),
        price_percentile("sale_price", 0.1).alias("p10_price"), price_percentile("sale_price", 0.5).alias("median_price"),
        price_percentile("sale_price", 0.9).alias("p90_price"), F.min("sale_price").alias("min_price"), F.max("sale_price").alias("max_price"),
        price(F.avg(F.col("sale_price").cast("double"))).alias("avg_price"),
    ).select(
        "survey_week_key", "week_start_date", F.floor(F.col("survey_week_key") / 100).cast("int").alias("iso_year"),
        F.trunc("week_start_date", "month").alias("month_start_date"), "city_key", "product_key", "observations", "stations",
        "p10_price", "median_price", "p90_price", "min_price", "max_price", "avg_price")
