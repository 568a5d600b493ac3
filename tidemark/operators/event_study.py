"""Before and after an event, next to the market at the same time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import quarter, week_start
from tidemark.functions.prices import mean, price
from tidemark.schemas import EVENT_WINDOW_DAYS, MIN_OBSERVATIONS

#: Days of the shortest quarter: a bin of no more days reaches two quarters at most.
QUARTER_DAYS = 90


def event_observations(events: DataFrame, facts: DataFrame, versions: Sequence[str], date: str, days: int = EVENT_WINDOW_DAYS) -> DataFrame:
    """Facts of the event's versions from ``days`` before its date to the day before ``days`` after it, with their phase.

    Time is cut into bins of ``days``: a window lists the two or three that it reaches, so version and bin are equal keys, and a fact meets
    the events near its day alone, not all of its station. If facts are stored by quarter, the quarters of a bin are a key, too, by
    which partitions without an event can be left out.
    """
    at, bin_of = F.col(date), lambda d: F.floor(F.unix_date(d) / days)
    keyed = events.withColumn("station_key", F.explode(F.array(*versions)))
    keyed = keyed.withColumn("bin", F.explode(F.sequence(bin_of(F.date_sub(at, days)), bin_of(F.date_add(at, days - 1)))))
    keys, columns = ["station_key", "bin"], ["station_key", "collection_date", "product_key", "sale_price"]
    if "quarter" in facts.columns and days <= QUARTER_DAYS:
        ends = [quarter(F.date_from_unix_date((F.col("bin") * days + n).cast("int"))) for n in (0, days - 1)]
        keyed, keys, columns = keyed.withColumn("quarter", F.explode(F.array_distinct(F.array(*ends)))), [*keys, "quarter"], [*columns, "quarter"]
    inside = (F.col("collection_date") >= F.date_sub(at, days)) & (F.col("collection_date") < F.date_add(at, days))
    joined = keyed.join(facts.select(*columns, bin_of(F.col("collection_date")).alias("bin")), keys).where(inside)
    return joined.drop("bin", "quarter").withColumn("phase", F.when(F.col("collection_date") < at, "before").otherwise("after"))


def station_observations(changes: DataFrame, facts: DataFrame, stations: DataFrame, days: int = EVENT_WINDOW_DAYS) -> DataFrame:
    """What ``event_observations`` and the versions' cities give for changes of stations, joined by station alone: facts that are
    stored in buckets by station stay where they are, and so do the groups of the result.

    A fact meets all changes of its own station, which are few in any history. The pseudo-dates of a placebo are many: see ``lent_observations``.
    """
    at = F.col("changed_on")
    placed = changes
    for side in ("before", "after"):
        cities = stations.select(F.col("station_key").alias(f"station_key_{side}"), F.col("city_key").alias(f"city_{side}"), "cnpj")
        placed = placed.join(cities, ["cnpj", f"station_key_{side}"])
    seen = placed.join(facts.select("cnpj", "station_key", "collection_date", "product_key", "sale_price"), "cnpj")
    key = F.col("station_key")
    inside = (F.col("collection_date") >= F.date_sub(at, days)) & (F.col("collection_date") < F.date_add(at, days))
    own = seen.where(inside & key.isin(F.col("station_key_before"), F.col("station_key_after")))
    city = F.when(key == F.col("station_key_before"), F.col("city_before")).otherwise(F.col("city_after"))
    return own.withColumn("city_key", city).drop("city_before", "city_after").withColumn("phase", F.when(F.col("collection_date") < at, "before").otherwise("after"))


def lent_observations(dates: DataFrame, stations: DataFrame, facts: DataFrame, days: int = EVENT_WINDOW_DAYS) -> DataFrame:
    """What ``event_observations`` gives if each of a city's dates (city_key, pseudo_date, times) is lent to each of its stations
    (cnpj, city_key; of one version each, so that cnpj tells their facts), joined by station alone; an observation has the ``times`` of
    its date beside it.

    A city's dates are listed once, by the bins of ``days`` that their windows reach: no more than there are days in its history. A
    station carries its city's list, and a fact looks up the place of its own bin, so pairs of station and date are never rows
    of their own, facts that are stored in buckets by station stay where they are, and so do the groups of the result.
    """
    at, bin_of = F.col("pseudo_date"), lambda d: F.floor(F.unix_date(d) / days).cast("int")
    reached = dates.withColumn("bin", F.explode(F.sequence(bin_of(F.date_sub(at, days)), bin_of(F.date_add(at, days - 1)))))
    binned = reached.groupBy("city_key", "bin").agg(F.collect_list(F.struct("pseudo_date", "times")).alias("dates"))
    lists = binned.groupBy("city_key").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.map_from_entries(F.collect_list(F.struct("bin", "dates"))).alias("by_bin"))
    lists = lists.select("city_key", "first", F.transform(F.sequence("first", "last"), lambda b: F.try_element_at("by_bin", b)).alias("lent"))
    placed = stations.join(lists, "city_key").select("cnpj", "city_key", "first", "lent")
    day = F.col("collection_date")
    seen = facts.select("cnpj", "station_key", "collection_date", "product_key", "sale_price").join(placed, "cnpj")
    near = F.filter(F.get("lent", bin_of(day) - F.col("first")), lambda d: (day >= F.date_sub(d["pseudo_date"], days)) & (day < F.date_add(d["pseudo_date"], days)))
    found = seen.select("cnpj", "city_key", "station_key", "collection_date", "product_key", "sale_price", F.inline(near))
    return found.withColumn("phase", F.when(day < at, "before").otherwise("after"))


def before_after(observations: DataFrame, keys: Sequence[str], least: int = MIN_OBSERVATIONS, times: str | None = None) -> DataFrame:
    """Mean price and count of either phase of each group with at least ``least`` observations in both. Means don't depend on the order of
    the rows. ``times`` names a column, of one value a group: each observation of the group counts so many times."""
    copies = F.max(times) if times else F.lit(1)
    phase = {p: F.col("phase") == p for p in ("before", "after")}
    grouped = observations.groupBy(*keys).agg(
        *[mean(F.when(c, F.col("sale_price")), copies).alias(f"price_{p}") for p, c in phase.items()], *[(F.count_if(c) * copies).alias(f"obs_{p}") for p, c in phase.items()])
    return grouped.where((F.col("obs_before") >= least) & (F.col("obs_after") >= least))


def effect(cases: DataFrame, weekly: DataFrame, date: str, days: int = EVENT_WINDOW_DAYS) -> DataFrame:
    """``cases`` with the station's change, its market's, and the excess of the first over the second.

    The market's change is the mean of the city's weekly medians from the date on less that before it, by the Mondays of the weeks; null where a
    side has no week. Each case lists the Mondays of its window, so the join is one of equal keys; cases come grouped, and stay where
    they are while the medians of their weeks are gathered.
    """
    at, case = F.col(date), cases.columns
    first = F.date_add(week_start(F.date_sub(at, days + 1)), 7)  # the first Monday not before the window
    mondays = cases.withColumn("week_start_date", F.explode_outer(F.sequence(first, F.date_add(at, days - 1), F.expr("interval 7 days"))))
    medians = weekly.select("city_key", "product_key", "week_start_date", F.col("median_price").alias("median"))
    side = lambda c: mean(F.when(c, F.col("median")))
    joined = mondays.join(medians, ["city_key", "product_key", "week_start_date"], "left")
    found = joined.groupBy(*case).agg((side(F.col("week_start_date") >= at) - side(F.col("week_start_date") < at)).alias("market_change"))
    changed = found.withColumn("station_change", F.col("price_after") - F.col("price_before"))
    return changed.withColumn("excess_change", F.col("station_change") - F.col("market_change"))


def brand_change_effect(changes: DataFrame, facts: DataFrame, stations: DataFrame, weekly: DataFrame, days: int = EVENT_WINDOW_DAYS, least: int = MIN_OBSERVATIONS, in_buckets: bool = False) -> DataFrame:
    """The effect of each brand change on each product of the station, against its own city. ``in_buckets`` tells that facts and
    stations are stored in buckets by cnpj."""
    seen = station_observations(changes, facts, stations, days) if in_buckets else event_observations(changes, facts, ("station_key_before", "station_key_after"), "changed_on", days).join(stations.select("station_key", "city_key"), "station_key")
    cases = before_after(seen, ["cnpj", "change_type", "brand_before", "brand_after", "changed_on", "city_key", "product_key"], least)
    return effect(cases, weekly, "changed_on", days)


def stable_stations(stations: DataFrame) -> DataFrame:
    """Stations of a single version."""
    return stations.groupBy("cnpj").agg(F.count(F.lit(1)).alias("versions"), F.min("station_key").alias("station_key"), F.min("city_key").alias("city_key")).where("versions = 1").drop("versions")


def placebo_effect(
    changes: DataFrame, facts: DataFrame, stations: DataFrame, weekly: DataFrame, product_key: int, kind: str | None = "desbandeiramento",
    days: int = EVENT_WINDOW_DAYS, least: int = MIN_OBSERVATIONS, dedupe_pairs: bool = True, in_buckets: bool = False,
) -> DataFrame:
    """The effect that events seem to have on stations that had none: each event lends its date to the stable stations of
    its city. With ``dedupe_pairs`` two events of a city on one date lend it once; without, it counts twice. ``in_buckets`` tells
    that facts and stations are stored in buckets by cnpj."""
    chosen = changes.where(F.col("change_type") == kind) if kind else changes
    cities = stations.select(F.col("station_key").alias("station_key_after"), "city_key")
    dates = chosen.join(cities, "station_key_after").groupBy("city_key", F.col("changed_on").alias("pseudo_date")).agg(F.count(F.lit(1)).alias("times"))
    dates = dates.withColumn("times", F.lit(1)) if dedupe_pairs else dates
    own = facts.where(F.col("product_key") == product_key)
    if in_buckets:
        seen = lent_observations(dates, stable_stations(stations), own, days)
    else:
        seen = event_observations(dates.join(stable_stations(stations), "city_key"), own, ("station_key",), "pseudo_date", days)
    cases = before_after(seen, ["cnpj", "pseudo_date", "city_key", "product_key"], least, "times")
    return effect(cases, weekly, "pseudo_date", days)


def summary(cases: DataFrame, *groups: str) -> DataFrame:
    """Number, mean, median, deviation and standard error of the excess change, and the share of cases below the market."""
    x, n = F.col("excess_change"), F.count(F.lit(1))
    below = F.count_if(x < 0)
    deviation = F.stddev_samp(x)
    four = lambda c: F.round(F.round(c, 9), 4)
    return cases.groupBy(*groups).agg(
        n.alias("cases"), four(F.avg(x)).alias("mean_effect"), four(F.percentile(x, 0.5)).alias("median_effect"),
        four(deviation).alias("deviation"), four(deviation / F.sqrt(n)).alias("standard_error"), below.alias("below_market"),
        F.round(F.round(100 * below / F.nullif(n, F.lit(0)), 9), 1).alias("pct_below"))


def as_prices(cases: DataFrame) -> DataFrame:
    return cases.withColumns({c: price(F.col(c)) for c in ("price_before", "price_after", "station_change", "market_change", "excess_change")})
