"""Views of operation: runs, rejects, brands to review, partitions, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import STUCK_MINUTES

ZONE = "America/Sao_Paulo"


def load_health(runs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Runs with their duration, share of rejects (null without rows), and local times."""
    seconds = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    share = F.round(100.0 * F.col("rows_rejected") / F.nullif(F.col("rows_in"), F.lit(0)), 2)
    local = lambda c: F.from_utc_timestamp(c, ZONE)
    return runs.join(catalog.select("source_file_id", "half_year"), "source_file_id", "left").select(
        "run_id", "half_year", "stage", "status", local("started_at").alias("started_local"), local("finished_at").alias("finished_local"),
        seconds.alias("seconds"), "rows_in", "rows_out", "rows_rejected", share.cast("double").alias("pct_rejected"), "message")


def stuck_runs(runs: DataFrame, now: str | None = None, minutes: int = STUCK_MINUTES) -> DataFrame:
    """Runs that are still open after ``minutes``."""
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    open_for = (F.unix_timestamp(at) - F.unix_timestamp("started_at")) / 60
    return runs.where((F.col("status") == "running") & (open_for > minutes)).select("run_id", "source_file_id", "stage", "started_at", F.floor(open_for).alias("minutes"))


def reject_summary(rejects: DataFrame, catalog: DataFrame) -> DataFrame:
    return rejects.join(catalog.select("source_file_id", "half_year"), "source_file_id").groupBy("half_year", "rule_name").agg(F.count(F.lit(1)).alias("rejects"))


def brands_to_review(brands: DataFrame) -> DataFrame:
    return brands.where("needs_review").select("brand_key", "brand_name")


def partition_health(facts: DataFrame) -> DataFrame:
    """Rows, days and files of each quarter; rows outside all quarters are anomalous."""
    return facts.groupBy("quarter").agg(
        F.count(F.lit(1)).alias("rows"), F.min("collection_date").alias("first_day"), F.max("collection_date").alias("last_day"),
        F.count_distinct("source_file_id").alias("files")).withColumn("is_anomalous", F.col("quarter") == "default")


def reconciliation(staged: DataFrame, rejects: DataFrame, facts: DataFrame) -> DataFrame:
    """Of each file: rows staged, rejected, stored, and those that went into a row of equal grain."""
    count = lambda df, name: df.groupBy("source_file_id").agg(F.count(F.lit(1)).alias(name))
    joined = count(staged, "staged").join(count(rejects, "rejected"), "source_file_id", "left").join(count(facts, "facts"), "source_file_id", "left")
    filled = joined.fillna(0, ["rejected", "facts"])
    return filled.withColumn("merged", F.col("staged") - F.col("rejected") - F.col("facts"))


def versions_by_year(stations: DataFrame) -> DataFrame:
    return stations.groupBy(F.year("valid_from").alias("year")).agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("cnpj").alias("stations"))
