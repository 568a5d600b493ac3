"""Dates: the survey week, the calendar, and the quarter that a fact is stored under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import CALENDAR, FACT_QUARTERS

# Month and day names, Monday first.
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
DAYS = ("segunda", "terça", "quarta", "quinta", "sexta", "sábado", "domingo")


def week_key(day: Column) -> Column:
    """ISO year * 100 + ISO week: 2024-12-30 is in 202501."""
    return (F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)).cast("int")


def week_start(day: Column) -> Column:
    """The Monday of a day's ISO week."""
    return F.trunc(day, "week")


def week_month(day: Column) -> Column:
    """The first day of the month that a week belongs to: that of its Monday."""
    return F.trunc(week_start(day), "month")


def quarter(day: Column) -> Column:
    """The partition label of a day, such as 2024q1; days outside the fact's range go to 'default'."""
    label = F.concat(F.year(day), F.lit("q"), F.quarter(day))
    return F.when(F.year(day).between(*FACT_QUARTERS), label).otherwise("default")


def between(facts: DataFrame, low: str, high: str | None = None, day: str = "collection_date") -> DataFrame:
    """Facts with low <= day < high. If they are partitioned by quarter, the bounds prune partitions, too."""
    kept = facts.where(F.col(day) >= F.lit(low).cast("date"))
    if high:
        kept = kept.where(F.col(day) < F.lit(high).cast("date"))
    if "quarter" in facts.columns:
        inside = F.col("quarter") >= quarter(F.lit(low).cast("date"))
        if high:
            inside = inside & (F.col("quarter") <= quarter(F.lit(high).cast("date")))
        kept = kept.where(inside | (F.col("quarter") == "default"))
    return kept


def calendar(spark: SparkSession, first: str = CALENDAR[0], last: str = CALENDAR[1]) -> DataFrame:
    """One row a day, with the 15 columns of the date dimension."""
    day, iso = F.col("full_date"), F.extract(F.lit("DAYOFWEEK_ISO"), F.col("full_date"))
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int"))
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("full_date"))
    return days.select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("date_key"), day, F.year(day).alias("year"), F.quarter(day).alias("quarter"),
        F.month(day).alias("month"), pick(MONTHS, F.month(day)).alias("month_name"), F.dayofmonth(day).alias("day"),
        iso.cast("int").alias("iso_day_of_week"), pick(DAYS, iso).alias("day_name"), (iso >= 6).alias("is_weekend"),
        F.extract(F.lit("YEAROFWEEK"), day).cast("int").alias("iso_year"), F.weekofyear(day).alias("iso_week"),
        week_key(day).alias("survey_week_key"), week_start(day).alias("week_start_date"), F.trunc(day, "month").alias("month_start_date"),
    )
