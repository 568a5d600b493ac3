"""Queries of the survey model over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import calendar
from tidemark.functions.prices import rounded
from tidemark.operators import checks, profile
from tidemark.operators.clean import accepted, clean, rejects
from tidemark.operators.facts import lowest_price
from tidemark.operators.history import as_of
from tidemark.operators.keys import resolve_brands, resolve_cities, unused_brands
from tidemark.plans import loading, ops, questions, views
from tidemark.plans.analog import DAYS, ETHANOL, GASOLINE, LEAST, bucketed_model, model, observations, raw_products, raw_survey, table
from tidemark.plans.oracle import SQL
from tidemark.schemas import CITY
from tidemark.sources import seeds

Query = Callable[[SparkSession, str], DataFrame]
_FUELS = {"ethanol": ETHANOL, "gasoline": GASOLINE}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema])


def _view(view: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, sf_dir: plain(view(model(spark, sf_dir), **options))


def weekly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(model(spark, sf_dir).weekly)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir).stations.select("cnpj", "brand_key", "city_key", "valid_from", "valid_to", "is_current")


def lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(lowest_price(observations(spark, sf_dir)).drop("source_file_id"))


def facts_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    names = m.stations.select("station_key", "brand_key", "valid_from")
    return plain(m.facts.join(names, "station_key").select("cnpj", "product_key", "collection_date", "sale_price", "brand_key", "valid_from", "quarter"))


def facts_as_of_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of each price's day, looked up by range, where facts and stations lie in buckets by station."""
    m = bucketed_model(spark, sf_dir)
    found = as_of(m.facts.drop("station_key"), m.stations.select("cnpj", "brand_key", "valid_from", "valid_to"), "cnpj", "collection_date")
    return plain(found.select("cnpj", "product_key", "collection_date", "sale_price", "brand_key", "valid_from", "quarter"))


def event_effect_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(views.brand_effect(bucketed_model(spark, sf_dir), DAYS, LEAST, in_buckets=True))


def adjacent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir).brand_changes.select("cnpj", "brand_before", "brand_after", "changed_on", "change_type")


def change_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir).brand_changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("cnpj").alias("stations"))


def never_used_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    return unused_brands(m.brands, m.stations.where("is_current")).select("brand_name")


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(raw_survey(spark, sf_dir), raw_products(spark), ("2023-01-01", "2027-12-31"), 50)


def clean_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = accepted(_cleaned(spark, sf_dir))
    return plain(kept.select("line_number", "cnpj", "collection_date", "sale_price", "legal_name", "city_name", "uf", "region", "street", "zip_code", "product_key"))


def reject_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select("line_number", "reject_rule")


def reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reject_summary(rejects(_cleaned(spark, sf_dir)), seeds.catalog(spark))


def reject_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rejects(_cleaned(spark, sf_dir), samples=5)
    return found.groupBy("rule_name").agg(F.count(F.lit(1)).alias("rejects"), F.count("raw_row").alias("samples"), F.min("detail").alias("least_detail"))


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cleaned(spark, sf_dir)
    return ops.reconciliation(rows, rejects(rows), lowest_price(accepted(rows)))


def brand_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, brands, _ = resolve_brands(accepted(_cleaned(spark, sf_dir)), seeds.brands(spark), seeds.aliases(spark))
    named = rows.join(brands.select("brand_key", "brand_name", "is_unbranded", "needs_review"), "brand_key")
    return named.groupBy("brand_name", "is_unbranded", "needs_review").agg(F.count(F.lit(1)).alias("rows"))


def city_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cities = resolve_cities(accepted(_cleaned(spark, sf_dir)), spark.createDataFrame([], CITY))
    return rows.drop("city_name", "uf", "region").join(cities, "city_key").groupBy("city_name", "uf", "region").agg(F.count(F.lit(1)).alias("rows"))


def brands_to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, brands, _ = resolve_brands(accepted(_cleaned(spark, sf_dir)), seeds.brands(spark), seeds.aliases(spark))
    return ops.brands_to_review(brands).select("brand_name")


def partition_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.partition_health(model(spark, sf_dir).facts)


def versions_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.versions_by_year(model(spark, sf_dir).stations)


def calendar_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(spark)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))


def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(profile.duplicates(_lines(spark, sf_dir), ["l_orderkey", "l_linenumber"], "price"))


def duplicate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.gap_summary(_lines(spark, sf_dir), ["l_orderkey", "l_linenumber"], "price")


def grain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.grain(observations(spark, sf_dir), ["cnpj", "product_key"], "collection_date", "sale_price")


def weekday_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.weekdays(table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")), "day")


def month_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.months(table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")), "day")


def keys_in_many_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.in_many(_lines(spark, sf_dir), "l_suppkey", "l_partkey")


def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
    first, second = orders.where("day < date'1998-01-01'"), orders.where("day >= date'1998-01-01'")
    return profile.transitions(first, second, "o_custkey", "o_orderpriority")


def attribute_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.attribute_changes(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.columns(raw_survey(spark, sf_dir), ["estado_sigla", "cnpj_da_revenda", "produto", "bandeira", "cep"])


def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missing_fields(raw_survey(spark, sf_dir), "cnpj_da_revenda", ["revenda", "produto", "bandeira"])


def overlapping_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.overlapping(model(spark, sf_dir).stations, "cnpj").select("cnpj", "valid_from")


def repeated_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.repeated(observations(spark, sf_dir), "cnpj", "product_key", "collection_date")


def dangling_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that lines name and that there aren't: some orders name a part by its negative key."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    named = F.when(F.col("l_orderkey") % 97 == 3, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    return checks.dangling(_lines(spark, sf_dir).withColumn("l_partkey", named), parts, "l_partkey").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("rows"))


def placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.placebo_comparison(model(spark, sf_dir), product=GASOLINE, days=DAYS, least=LEAST)


def placebo_pairs_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.placebo_comparison(model(spark, sf_dir), product=GASOLINE, days=DAYS, least=LEAST, dedupe_pairs=False)


def placebo_in_buckets(spark: SparkSession, sf_dir: str, dedupe_pairs: bool = True) -> DataFrame:
    return questions.placebo_comparison(bucketed_model(spark, sf_dir), product=GASOLINE, days=DAYS, least=LEAST, dedupe_pairs=dedupe_pairs, in_buckets=True)


def placebo_pairs_kept_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placebo_in_buckets(spark, sf_dir, dedupe_pairs=False)


def series_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(questions.series_price(model(spark, sf_dir), GASOLINE))


def order_value_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star join at its widest: exact median order value by region, year and priority."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    star = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return star.groupBy(F.col("r_name").alias("region"), F.year("o_orderdate").alias("year"), "o_orderpriority").agg(
        rounded(F.percentile("o_totalprice", 0.5), 2).alias("median_value"), F.count(F.lit(1)).alias("orders"))


QUERIES: dict[str, Query] = {
    "weekly_rollup": weekly_rollup,
    "weekly_median_by_region": _view(questions.weekly_series, product=GASOLINE, since="2024-01-08"),
    "weighted_series_stations": _view(views.weekly_price_by_uf),
    "weighted_series_observations": _view(views.price_weekly_uf, trim=False, **_FUELS),
    "weighted_series_trimmed": _view(views.price_weekly_uf, trim=True, **_FUELS),
    "weekly_change": _view(views.weekly_change),
    "dispersion_floor": _view(views.price_dispersion, min_stations=3),
    "dispersion_topk": _view(questions.dispersion_top, product=GASOLINE, since="2024-01-01", until="2024-02-01", min_stations=2),
    "parity_weekly": _view(views.ethanol_parity, **_FUELS),
    "parity_base": _view(views.parity_base, **_FUELS),
    "edge_trim": _view(views.week_scope, **_FUELS),
    "parity_edge_trimmed": _view(views.parity_weekly, **_FUELS),
    "parity_monthly_two_level": _view(questions.monthly_parity, since="2024-01-01", **_FUELS),
    "parity_share_by_region": _view(views.parity_share, **_FUELS),
    "coverage": _view(views.sample_coverage),
    "coverage_drop": _view(views.coverage_drop),
    "series_all": series_all,
    "distinct_on_min_price": lowest,
    "scd2_versions": versions,
    "scd2_current": _view(views.station_current),
    "scd2_adjacent_changes": adjacent_changes,
    "change_type_counts": change_type_counts,
    "asof_fact_join": facts_as_of,
    "asof_in_buckets": facts_as_of_in_buckets,
    "flat_observation": _view(views.price_observation),
    "brand_timeline": _view(views.brand_timeline),
    "event_effect": _view(views.brand_effect, days=DAYS, least=LEAST),
    "event_effect_in_buckets": event_effect_in_buckets,
    "event_summary": _view(questions.change_summary, product=GASOLINE, since="2024-01-01", until="2024-02-01", days=DAYS, least=LEAST),
    "event_by_brand_t": _view(questions.effect_by_brand, least_cases=10, days=DAYS, least=LEAST),
    "placebo_vs_event": placebo,
    "placebo_pairs_kept": placebo_pairs_kept,
    "placebo_in_buckets": placebo_in_buckets,
    "placebo_pairs_kept_in_buckets": placebo_pairs_kept_in_buckets,
    "city_semi_join": _view(views.site_city),
    "unused_brand_anti_join": never_used_brands,
    "clean_normalise": clean_normalise,
    "reject_classification": reject_classification,
    "reject_summary": reject_summary,
    "reject_samples": reject_samples,
    "reconciliation": reconciliation,
    "brand_resolution": brand_resolution,
    "city_resolution": city_resolution,
    "brands_to_review": brands_to_review,
    "partition_health": partition_health,
    "versions_by_year": versions_by_year,
    "calendar_dim": calendar_dim,
    "duplicate_audit": duplicate_audit,
    "duplicate_gaps": duplicate_gaps,
    "grain_check": grain_check,
    "weekday_histogram": weekday_histogram,
    "month_histogram": month_histogram,
    "keys_in_many_places": keys_in_many_places,
    "dominant_transition_matrix": transition_matrix,
    "attribute_changes": attribute_changes,
    "source_profile": source_profile,
    "missing_fields": missing_fields,
    "overlapping_versions": overlapping_versions,
    "repeated_grain": repeated_grain,
    "dangling_keys": dangling_suppliers,
    "order_value_by_region": order_value_by_region,
}


def queries() -> dict[str, Query]:
    return QUERIES | loading.QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
