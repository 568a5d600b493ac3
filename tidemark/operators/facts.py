"""Facts: one price a station, product and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import quarter
from tidemark.operators.history import as_of, one_per, versions
from tidemark.schemas import STATION_ATTRIBUTES


def lowest_price(rows: DataFrame, keys: tuple[str, ...] = ("cnpj", "product_key", "collection_date"), value: str = "sale_price", source: str = "source_file_id") -> DataFrame:
    """One row a grain: of several prices the lowest, with the first file that has it. A partial aggregate, whatever repeats."""
    best = rows.groupBy(*keys).agg(F.min(F.struct(value, source)).alias("best"))
    return best.select(*keys, f"best.{value}", f"best.{source}")


def station_snapshots(rows: DataFrame) -> DataFrame:
    """Attributes of each station on each day: those of the first file and line."""
    columns = ["cnpj", "collection_date", *STATION_ATTRIBUTES, "complement", "source_file_id", "line_number"]
    return one_per(rows.select(*columns), ["cnpj", "collection_date"], ["source_file_id", "line_number"]).drop("line_number")


def build_stations(snapshots: DataFrame) -> DataFrame:
    """Station versions from all snapshots, whatever the order of the files. The key of a version is a hash of its station
    and first day, so rebuilding gives the same keys. The complement makes no version."""
    spans = versions(snapshots, "cnpj", "collection_date", STATION_ATTRIBUTES, ("complement",), "source_file_id")
    state = F.md5(F.concat_ws("|", *[F.coalesce(F.col(a).cast("string"), F.lit("")) for a in STATION_ATTRIBUTES]))
    return spans.select(
        F.xxhash64("cnpj", "valid_from").alias("station_key"), "cnpj", *STATION_ATTRIBUTES, "complement", "valid_from", "valid_to", "is_current",
        F.col("first_source_file_id").alias("first_seen_file"), F.col("last_source_file_id").alias("last_seen_file"), state.alias("attribute_hash"))


def build_facts(prices: DataFrame, stations: DataFrame, how: str = "inner", *more: str) -> DataFrame:
    """Prices with the station version of their day, the quarter that they are stored under, and ``more`` of their own columns.
    Prices without a version go, or, if ``how`` is left, have none."""
    placed = as_of(prices, stations.select("cnpj", "station_key", "valid_from", "valid_to"), "cnpj", "collection_date", how)
    return placed.select("collection_date", "cnpj", "station_key", "product_key", "sale_price", "source_file_id", quarter(F.col("collection_date")).alias("quarter"), *more)
