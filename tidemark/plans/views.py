"""Views: functions of a Model that give DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import week_key, week_start
from tidemark.functions.prices import price, ratio, rounded, weighted_mean
from tidemark.operators.event_study import as_prices, brand_change_effect
from tidemark.plans.model import Model
from tidemark.schemas import EVENT_WINDOW_DAYS, MIN_OBSERVATIONS, MIN_STATIONS, PARITY_LIMIT

GASOLINE, ETHANOL = 1, 3


def _named(m: Model, *city: str) -> DataFrame:
    products = m.products.select("product_key", "product_name")
    return m.weekly.join(m.cities.select("city_key", *city), "city_key").join(products, "product_key")


def price_observation(m: Model) -> DataFrame:
    """One wide row a fact. Brand and city are those in force on the day."""
    day = F.col("collection_date")
    brands = m.brands.select("brand_key", "brand_name", "is_unbranded")
    stations = m.stations.select("station_key", "cnpj", "legal_name", "district", "city_key", "brand_key")
    products = m.products.select("product_key", "product_name", "fuel_family", "unit_of_measure")
    wide = m.facts.select("collection_date", "station_key", "product_key", "sale_price").join(stations, "station_key").join(products, "product_key")
    wide = wide.join(m.cities.select("city_key", "region", "uf", "city_name"), "city_key").join(brands, "brand_key")
    return wide.select(
        "collection_date", week_key(day).alias("survey_week_key"), week_start(day).alias("week_start_date"), F.trunc(day, "month").alias("month_start_date"),
        F.floor(week_key(day) / 100).cast("int").alias("iso_year"), "product_name", "fuel_family", "unit_of_measure", "region", "uf", "city_name",
        "brand_name", "is_unbranded", "cnpj", "legal_name", "district", "sale_price")


def weekly_price_by_uf(m: Model) -> DataFrame:
    """Mean of city medians weighted by stations: not the median of the state."""
    return _named(m, "region", "uf").groupBy("survey_week_key", "week_start_date", "region", "uf", "product_name").agg(
        F.sum("observations").alias("observations"), F.sum("stations").alias("stations"), price(weighted_mean("median_price", "stations")).alias("median_price"))


def weekly_change(m: Model) -> DataFrame:
    """Change of a city's median against its previous week that has one."""
    before = F.lag("median_price").over(Window.partitionBy("city_key", "product_key").orderBy("survey_week_key"))
    lagged = m.weekly.withColumn("previous_price", before)
    named = lagged.join(m.cities.select("city_key", "uf", "city_name"), "city_key").join(m.products.select("product_key", "product_name"), "product_key")
    now, then = F.col("median_price"), F.col("previous_price")
    return named.select(
        "survey_week_key", "week_start_date", "uf", "city_name", "product_name", now, then, (now - then).cast("decimal(8,3)").alias("change_value"),
        rounded(100 * (ratio(now, then) - 1), 2).alias("change_pct"), "stations")


def price_dispersion(m: Model, min_stations: int = MIN_STATIONS) -> DataFrame:
    """Spread between the tenth and the ninetieth percentile, where enough stations were asked."""
    spread = F.col("p90_price") - F.col("p10_price")
    return _named(m, "uf", "city_name").where(F.col("stations") >= min_stations).select(
        "survey_week_key", "week_start_date", "uf", "city_name", "product_name", "p10_price", "median_price", "p90_price",
        spread.cast("decimal(8,3)").alias("spread_value"), rounded(100 * ratio(spread, F.col("median_price")), 2).alias("spread_pct"), "stations")


def _pair(weekly: DataFrame, *keys: str, ethanol: int, gasoline: int) -> DataFrame:
    """Ethanol and gasoline side by side; groups that lack one are dropped."""
    p, value = F.col("product_key"), F.col("median_price")
    return weekly.where(p.isin(ethanol, gasoline)).groupBy(*keys).agg(
        F.max(F.when(p == ethanol, value)).alias("ethanol_price"), F.max(F.when(p == gasoline, value)).alias("gasoline_price"),
        F.min("stations").alias("min_stations"), F.sum("observations").alias("observations"),
    ).where("ethanol_price is not null and gasoline_price is not null")


def ethanol_parity(m: Model, ethanol: int = ETHANOL, gasoline: int = GASOLINE, limit: float = PARITY_LIMIT) -> DataFrame:
    """Price of ethanol in gasolines, by week and city; ethanol wins below the limit, judged before rounding."""
    pair = _pair(m.weekly, "survey_week_key", "week_start_date", "city_key", ethanol=ethanol, gasoline=gasoline)
    parity = ratio(F.col("ethanol_price"), F.col("gasoline_price"))
    return pair.join(m.cities.select("city_key", "uf", "city_name"), "city_key").select(
        "survey_week_key", "week_start_date", "uf", "city_name", "ethanol_price", "gasoline_price", rounded(parity, 4).alias("parity_ratio"),
        (parity < limit).alias("ethanol_wins"), "min_stations")


def parity_base(m: Model, ethanol: int = ETHANOL, gasoline: int = GASOLINE) -> DataFrame:
    pair = _pair(m.weekly, "week_start_date", "city_key", ethanol=ethanol, gasoline=gasoline)
    return pair.select("week_start_date", "city_key", "ethanol_price", "gasoline_price", rounded(ratio(F.col("ethanol_price"), F.col("gasoline_price")), 4).alias("parity_ratio"), "observations")


def week_scope(m: Model, ethanol: int = ETHANOL, gasoline: int = GASOLINE) -> DataFrame:
    """Weeks strictly between the first and the last, which files cut short, with the number of cities that have both fuels."""
    covered = parity_base(m, ethanol, gasoline).groupBy("week_start_date").agg(F.count_distinct("city_key").alias("cities"))
    edges = covered.agg(F.min("week_start_date").alias("first"), F.max("week_start_date").alias("last"))  # one row
    return covered.crossJoin(F.broadcast(edges)).where("week_start_date > first and week_start_date < last").drop("first", "last")


def parity_weekly(m: Model, ethanol: int = ETHANOL, gasoline: int = GASOLINE) -> DataFrame:
    return parity_base(m, ethanol, gasoline).join(week_scope(m, ethanol, gasoline), "week_start_date")


def site_city(m: Model) -> DataFrame:
    """Cities that have a price."""
    return m.cities.join(m.weekly.select("city_key").distinct(), "city_key", "left_semi").select("city_key", "city_name", "uf", "region")


def price_weekly_uf(m: Model, trim: bool = True, ethanol: int = ETHANOL, gasoline: int = GASOLINE) -> DataFrame:
    """Means of city percentiles weighted by observations, liquid fuels in scope; ``trim`` leaves out the edge weeks."""
    products = m.products.where("in_default_scope and is_liquid_fuel").select("product_key", "product_name", "fuel_family")
    named = m.weekly.join(m.cities.select("city_key", "uf", "region"), "city_key").join(products, "product_key")
    mean = lambda c: rounded(weighted_mean(c, "observations"), 3)
    out = named.groupBy("week_start_date", "uf", "region", "product_name", "fuel_family").agg(
        mean("median_price").alias("weighted_mean_of_medians"), mean("p10_price").alias("p10_weighted"), mean("p90_price").alias("p90_weighted"),
        F.sum("observations").alias("observations"), F.sum("stations").alias("stations"), F.count_distinct("city_key").alias("cities"))
    return out.join(week_scope(m, ethanol, gasoline).select("week_start_date"), "week_start_date", "left_semi") if trim else out


def sample_coverage(m: Model) -> DataFrame:
    return m.weekly.join(m.products.select("product_key", "product_name"), "product_key").groupBy("survey_week_key", "week_start_date", "product_name").agg(
        F.count_distinct("city_key").alias("cities"), F.sum("stations").alias("stations"), F.sum("observations").alias("observations"))


def coverage_drop(m: Model) -> DataFrame:
    """Change of the number of cities from one week to the next."""
    before = F.lag("cities").over(Window.partitionBy("product_name").orderBy("survey_week_key"))
    return sample_coverage(m).select("survey_week_key", "product_name", "cities", before.alias("previous_cities"), (F.col("cities") - before).alias("change"))


def brand_effect(m: Model, days: int = EVENT_WINDOW_DAYS, least: int = MIN_OBSERVATIONS, in_buckets: bool = False) -> DataFrame:
    cases = brand_change_effect(m.brand_changes, m.facts, m.stations, m.weekly, days, least, in_buckets)
    named = as_prices(cases).join(m.cities.select("city_key", "uf", "city_name"), "city_key").join(m.products.select("product_key", "product_name"), "product_key")
    return named.select(
        "cnpj", "change_type", "brand_before", "brand_after", "changed_on", "uf", "city_name", "product_name", "price_before", "price_after",
        "station_change", "market_change", "excess_change", "obs_before", "obs_after")


def station_current(m: Model) -> DataFrame:
    names = m.brands.select("brand_key", "brand_name")
    return m.stations.where("is_current").join(names, "brand_key").join(m.cities.select("city_key", "city_name", "uf"), "city_key").select(
        "cnpj", "legal_name", "brand_name", "city_name", "uf", "valid_from")


def brand_timeline(m: Model) -> DataFrame:
    """Every brand with its stations and the first and last version that had it; brands without any have nulls."""
    return m.brands.join(m.stations.select("brand_key", "cnpj", "valid_from", "is_current"), "brand_key", "left").groupBy("brand_name").agg(
        F.count_distinct("cnpj").alias("stations"), F.min("valid_from").alias("first_version"), F.max("valid_from").alias("last_version"),
        F.count_if("is_current").alias("current_stations"))


def parity_share(m: Model, min_weeks: int = 0, ethanol: int = ETHANOL, gasoline: int = GASOLINE) -> DataFrame:
    """Share of a state's city weeks in which ethanol wins."""
    return ethanol_parity(m, ethanol, gasoline).groupBy("uf").agg(
        F.count(F.lit(1)).alias("city_weeks"), F.count_if("ethanol_wins").alias("wins"),
        rounded(100 * F.count_if("ethanol_wins") / F.count(F.lit(1)), 1).alias("pct_wins")).where(F.col("city_weeks") > min_weeks)

