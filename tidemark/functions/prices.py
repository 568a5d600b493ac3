"""Exact percentiles and roundings of prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def price(value: Column) -> Column:
    """To three decimals, halves away from zero. Noise beyond the ninth decimal is taken off first, so that the middle of
    5.100 and 5.201 is 5.151 and not what its nearest double falls to."""
    return F.round(value.cast("double"), 9).cast("decimal(8,3)")


def percentile(value: str | Column, q: float) -> Column:
    """Exact percentile with linear interpolation, as a double. Buffers of equal values merge map-side."""
    return F.percentile(F.col(value).cast("double") if isinstance(value, str) else value.cast("double"), q)


def mean(value: Column, times: Column | None = None) -> Column:
    """Mean of prices as a double that is the same in whatever order the rows come: their sum as doubles is exact and rounded once.
    A sum of doubles in the order of arrival is off by its last bit now and then, which decides a comparison of means that are equal.
    ``times`` is an aggregate: the mean is that of so many copies of each row.

    Up to three decimals and 2 ** 17 a price's double is a whole number of 2 ** -62, cut in two at 2 ** -22 so that sums of the parts are longs."""
    scaled = value.cast("double") * float(2**22)
    high = scaled.cast("long")
    low = ((scaled - high) * float(2**40)).cast("long")
    total = F.sum(high).cast("decimal(20,0)") * F.lit(2**40).cast("decimal(13,0)") + F.sum(low).cast("decimal(20,0)")
    n = F.nullif(F.count(value), F.lit(0))
    if times is not None:
        total, n = total * times.cast("decimal(19,0)"), n * times
    return total.cast("double") * 2.0**-62 / n


def price_percentile(value: str | Column, q: float) -> Column:
    return price(percentile(value, q))


def rounded(value: Column, digits: int) -> Column:
    return F.round(F.round(value.cast("double"), 9), digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0 or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def weighted_mean(value: str, weight: str) -> Column:
    return ratio(F.sum(F.col(value).cast("double") * F.col(weight)), F.sum(weight))
