"""Cleaning of survey text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(value: Column) -> Column:
    """Upper case, runs of white space to one space, none at the ends; null becomes empty."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")))


def normal_or_null(value: Column) -> Column:
    return F.nullif(normal(value), F.lit(""))


def digits(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"\D", "")


def parse_date(value: Column) -> Column:
    """dd/MM/yyyy with all its digits; anything else, or a day that doesn't exist, is null."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(text, "dd/MM/yyyy"))


def parse_price(value: Column) -> Column:
    """A number with a decimal comma, wide enough to be checked before it is cut to three decimals."""
    return F.replace(F.trim(F.coalesce(value, F.lit(""))), F.lit(","), F.lit(".")).try_cast("decimal(38,18)")
