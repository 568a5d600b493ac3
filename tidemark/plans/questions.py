"""The named questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import between, week_key, week_start
from tidemark.functions.prices import percentile, price_percentile, ratio, rounded
from tidemark.operators.event_study import before_after, event_observations, placebo_effect, summary
from tidemark.plans.model import Model
from tidemark.plans.views import ETHANOL, GASOLINE, brand_effect
from tidemark.schemas import EVENT_WINDOW_DAYS, MIN_OBSERVATIONS, MIN_STATIONS, PARITY_LIMIT


def _placed(m: Model, facts: DataFrame, *city: str) -> DataFrame:
    stations = m.stations.select("station_key", "city_key")
    return facts.select("collection_date", "station_key", "product_key", "sale_price").join(stations, "station_key").join(m.cities.select("city_key", *city), "city_key")


def weekly_series(m: Model, product: int = GASOLINE, since: str = "2025-07-01") -> DataFrame:
    """The true weekly median of each state, from the facts."""
    day = F.col("collection_date")
    facts = between(m.facts, since).where(F.col("product_key") == product)
    return _placed(m, facts, "uf").groupBy(week_key(day).alias("survey_week_key"), week_start(day).alias("week_start_date"), "uf").agg(
        rounded(percentile("sale_price", 0.5), 4).alias("median_price"), F.count(F.lit(1)).alias("observations"), F.count_distinct("station_key").alias("stations"))


def dispersion_top(m: Model, product: int = GASOLINE, since: str = "2025-01-01", until: str = "2026-01-01", min_stations: int = MIN_STATIONS, top: int = 50) -> DataFrame:
    """City weeks of the widest spread; ties by state, city and week."""
    day = F.col("collection_date")
    facts = between(m.facts, since, until).where(F.col("product_key") == product)
    grouped = _placed(m, facts, "uf", "city_name").groupBy("uf", "city_name", week_key(day).alias("survey_week_key")).agg(
        percentile("sale_price", 0.9).alias("high"), percentile("sale_price", 0.1).alias("low"), F.count_distinct("station_key").alias("stations"))
    spread = grouped.where(F.col("stations") >= min_stations).withColumn("spread", rounded(F.col("high") - F.col("low"), 3))
    return spread.orderBy(F.desc("spread"), "uf", "city_name", "survey_week_key").limit(top).select(
        "uf", "city_name", "survey_week_key", rounded(F.col("high"), 3).alias("p90"), rounded(F.col("low"), 3).alias("p10"), "spread", "stations")


def monthly_parity(m: Model, since: str = "2024-01-01", ethanol: int = ETHANOL, gasoline: int = GASOLINE, limit: float = PARITY_LIMIT) -> DataFrame:
    """Parity of monthly means by city, by the month of the day; months that lack a fuel are left out."""
    facts = between(m.facts, since).where(F.col("product_key").isin(ethanol, gasoline))
    monthly = _placed(m, facts, "uf", "city_name").groupBy("uf", "city_name", F.trunc("collection_date", "month").alias("month_start_date"), "product_key").agg(
        F.avg(F.col("sale_price").cast("double")).alias("mean_price"))
    p, value = F.col("product_key"), F.col("mean_price")
    pair = monthly.groupBy("uf", "city_name", "month_start_date").agg(
        F.max(F.when(p == ethanol, value)).alias("e"), F.max(F.when(p == gasoline, value)).alias("g")).where("e is not null and g is not null")
    parity = ratio(F.col("e"), F.col("g"))
    return pair.select(
        "uf", "city_name", "month_start_date", rounded(F.col("e"), 3).alias("ethanol"), rounded(F.col("g"), 3).alias("gasoline"),
        rounded(parity, 4).alias("parity"), (parity < limit).alias("ethanol_wins"))


def change_summary(m: Model, kind: str = "desbandeiramento", product: int = GASOLINE, since: str = "2024-01-01", until: str = "2025-07-01", days: int = EVENT_WINDOW_DAYS, least: int = MIN_OBSERVATIONS) -> DataFrame:
    """Prices of stations before and after a change of brand, one row. Changes of one station in one city run together."""
    events = m.brand_changes.where((F.col("change_type") == kind) & (F.col("changed_on") >= F.lit(since).cast("date")) & (F.col("changed_on") < F.lit(until).cast("date")))
    facts = m.facts.where(F.col("product_key") == product)
    seen = event_observations(events, facts, ("station_key_before", "station_key_after"), "changed_on", days).join(m.stations.select("station_key", "city_key"), "station_key")
    change = before_after(seen, ["cnpj", "city_key"], least).withColumn("change", F.col("price_after") - F.col("price_before"))
    return change.agg(
        F.count(F.lit(1)).alias("stations"), rounded(F.avg("change"), 4).alias("mean_change"), rounded(F.percentile("change", 0.5), 4).alias("median_change"),
        F.count_if(F.col("price_after") < F.col("price_before")).alias("fell"), F.count_if(F.col("price_after") > F.col("price_before")).alias("rose"))


def placebo_comparison(m: Model, product: int = GASOLINE, kind: str = "desbandeiramento", days: int = EVENT_WINDOW_DAYS, least: int = MIN_OBSERVATIONS, dedupe_pairs: bool = True, in_buckets: bool = False) -> DataFrame:
    """Effects of real changes by kind, next to those that the same dates seem to have on stations without a change."""
    placebo = placebo_effect(m.brand_changes, m.facts, m.stations, m.weekly, product, kind, days, least, dedupe_pairs, in_buckets)
    name = m.products.where(F.col("product_key") == product).select("product_name")
    real = brand_effect(m, days, least, in_buckets).join(name, "product_name", "left_semi").withColumn("excess_change", F.col("excess_change").cast("double"))
    columns = ["cases", "mean_effect", "median_effect", "deviation", "standard_error", "below_market", "pct_below"]
    none = summary(placebo).select(F.lit("placebo").alias("group"), *columns)
    return none.unionByName(summary(real, "change_type").select(F.concat(F.lit("event ("), "change_type", F.lit(")")).alias("group"), *columns))


def effect_by_brand(m: Model, least_cases: int = 10, days: int = EVENT_WINDOW_DAYS, least: int = MIN_OBSERVATIONS) -> DataFrame:
    """Mean effect of changes between two brands, with its standard error and t, for pairs with enough cases."""
    x = F.col("excess_change").cast("double")
    n, error = F.count(x), F.stddev_samp(x) / F.sqrt(F.count(x))
    return brand_effect(m, days, least).groupBy("brand_before", "brand_after").agg(
        n.alias("cases"), rounded(F.avg(x), 4).alias("mean_effect"), rounded(error, 4).alias("standard_error"), rounded(F.avg(x) / F.nullif(error, F.lit(0.0)), 3).alias("t"),
    ).where(F.col("cases") >= least_cases)


def series_price(m: Model, product: int = GASOLINE) -> DataFrame:
    """The weekly median of all cities together."""
    day = F.col("collection_date")
    return m.facts.where(F.col("product_key") == product).groupBy(week_key(day).alias("survey_week_key")).agg(price_percentile("sale_price", 0.5).alias("median_price"))
