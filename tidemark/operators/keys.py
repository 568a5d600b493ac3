"""Keys of brands and cities, resolved set by set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normal
from tidemark.sources.seeds import NO_BRAND


def newcomers(known: DataFrame, found: DataFrame, natural: Sequence[str], key: str) -> DataFrame:
    """Rows of ``found`` whose natural key ``known`` lacks, in the columns of ``known``. New keys follow the highest by natural order, so
    they don't depend on the order of arrival. Made for dimensions: new rows are numbered in one task."""
    missing = found.join(known.select(*natural), list(natural), "left_anti").dropDuplicates(list(natural))
    top = known.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).first()["top"]
    numbered = missing.withColumn(key, (F.row_number().over(Window.orderBy(*natural)) + F.lit(top)).cast(known.schema[key].dataType))
    return known.limit(0).unionByName(numbered, allowMissingColumns=True)


def extend(known: DataFrame, found: DataFrame, natural: Sequence[str], key: str) -> DataFrame:
    """``known`` with the rows of ``found`` (same columns but the key) whose natural key it lacks."""
    return known.unionByName(newcomers(known, found, natural, key))


def brand_name(raw):
    """Normal name of a raw brand; an empty one has a name of its own."""
    name = normal(raw)
    return F.when(name == "", F.lit(NO_BRAND)).otherwise(name)


def brand_keys(rows: DataFrame, aliases: DataFrame, raw: str = "brand_raw") -> DataFrame:
    """rows with the brand_key that the aliases give their raw brand; rows whose brand has no alias are left out."""
    return rows.withColumn("alias_text", brand_name(F.col(raw))).join(aliases.select("alias_text", "brand_key"), "alias_text").drop("alias_text")


def city_keys(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """rows with the city_key of their city and state; rows of unknown cities are left out."""
    return rows.join(cities.select("city_name", "uf", "city_key"), ["city_name", "uf"])


def new_brands(rows: DataFrame, brands: DataFrame, aliases: DataFrame, raw: str = "brand_raw") -> tuple[DataFrame, DataFrame]:
    """(brands, aliases without a key) that rows name for the first time: unknown names become brands that need a review, and
    their own aliases."""
    unknown = rows.select(brand_name(F.col(raw)).alias("alias_text")).distinct().join(aliases.select("alias_text"), "alias_text", "left_anti")
    fresh = unknown.select(F.col("alias_text").alias("brand_name"), F.lit(False).alias("is_unbranded"), (F.col("alias_text") != NO_BRAND).alias("needs_review"))
    return newcomers(brands, fresh, ["brand_name"], "brand_key"), unknown.select("alias_text", F.lit(False).alias("is_rename"), F.lit("new").alias("note"))


def new_cities(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """Cities that rows name for the first time. A city is its name and state; of several regions the least is kept."""
    return newcomers(cities, rows.groupBy("city_name", "uf").agg(F.min("region").alias("region")), ["city_name", "uf"], "city_key")


def resolve_brands(rows: DataFrame, brands: DataFrame, aliases: DataFrame, raw: str = "brand_raw") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with brand_key, brands, aliases): both tables with what is new in them."""
    more, names = new_brands(rows, brands, aliases, raw)
    brands = brands.unionByName(more)
    own = names.join(brands.select(F.col("brand_name").alias("alias_text"), "brand_key"), "alias_text")
    aliases = aliases.unionByName(own.select("alias_text", "brand_key", "is_rename", "note"))
    return brand_keys(rows, aliases, raw), brands, aliases


def resolve_cities(rows: DataFrame, cities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with city_key, cities)."""
    cities = cities.unionByName(new_cities(rows, cities))
    return city_keys(rows, cities), cities


def closure(merges: DataFrame) -> DataFrame:
    """(brand_key, into_key) with chains resolved: if A went into B and B into C, both lead to C. Each round follows two steps at
    once, so rounds are the logarithm of the longest chain. Made for dimensions."""
    now = merges.select("brand_key", "into_key")
    while True:
        step = now.select(F.col("brand_key").alias("into_key"), F.col("into_key").alias("next"))
        followed = now.join(step, "into_key", "left")
        if followed.where("next is not null").isEmpty():
            return now
        now = followed.select("brand_key", F.coalesce("next", "into_key").alias("into_key"))


def canonical(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """rows with the brand_key that theirs has gone into."""
    to = closure(merges).withColumnRenamed("into_key", "canonical_key")
    return rows.join(to, "brand_key", "left").withColumn("brand_key", F.coalesce("canonical_key", "brand_key")).select(*rows.columns)


def merge_brand(brands: DataFrame, aliases: DataFrame, stations: DataFrame, duplicate: str, canonical: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(brands, aliases, stations) after ``duplicate`` went into ``canonical``: its aliases and stations point there, as renames."""
    keys = {r["brand_name"]: r["brand_key"] for r in brands.where(F.col("brand_name").isin(duplicate, canonical)).collect()}
    if len(keys) < 2:
        raise ValueError(f"both {duplicate} and {canonical} must be brands, and differ")
    old, new = keys[duplicate], keys[canonical]
    moved = F.when(F.col("brand_key") == old, F.lit(new)).otherwise(F.col("brand_key"))
    renamed = aliases.withColumn("is_rename", F.col("is_rename") | (F.col("brand_key") == old)).withColumn("brand_key", moved)
    return brands.where(F.col("brand_key") != old), renamed, stations.withColumn("brand_key", moved)


def review(brands: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mark brands as reviewed. Unused seeds stay: a seed that no file has named yet is no mistake."""
    hit = F.col("brand_name").isin(*names)
    return brands.withColumn("needs_review", F.col("needs_review") & ~hit).withColumn("reviewed_at", F.when(hit, F.current_timestamp()).otherwise(F.col("reviewed_at")))


def unused_brands(brands: DataFrame, stations: DataFrame) -> DataFrame:
    return brands.join(stations.select("brand_key"), "brand_key", "left_anti")
