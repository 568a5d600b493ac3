"""The tables that views and questions read."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from tidemark.functions.dates import calendar
from tidemark.operators.history import brand_changes
from tidemark.operators.rollup import weekly_rollup
from tidemark.schemas import CALENDAR


@dataclass
class Model:
    """Facts point to station versions; a version has its city and brand. Dimensions are small next to facts, and joins to
    them are left to Catalyst, which broadcasts what is under its threshold."""

    facts: DataFrame
    stations: DataFrame
    cities: DataFrame
    products: DataFrame
    brands: DataFrame
    days: tuple[str, str] = CALENDAR
    weekly: DataFrame | None = None

    def __post_init__(self) -> None:
        self.weekly = self.weekly if self.weekly is not None else weekly_rollup(self.facts, self.stations)

    @cached_property
    def calendar(self) -> DataFrame:
        return calendar(self.cities.sparkSession, *self.days)

    @cached_property
    def brand_changes(self) -> DataFrame:
        return brand_changes(self.stations, self.brands)

    def register(self) -> None:
        """Temp views for SQL users, by their usual names."""
        for name in ("facts", "stations", "cities", "products", "brands", "calendar", "weekly", "brand_changes"):
            getattr(self, name).createOrReplaceTempView(f"survey_{name}")
