"""Versions of slowly changing entities: built from snapshots, looked up as of a date, compared with their neighbours.

Versions are always rebuilt from all snapshots of an entity, so files may come in any order and more than once, and an
attribute that returns to an earlier value makes a version of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schemas import FOREVER


def one_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each group of ``keys`` by ``order``: a partial aggregate, not a sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("first_row"))
    return best.select(*keys, "first_row.*").select(*df.columns)


def changed_keys(old: DataFrame, new: DataFrame, keys: Sequence[str], day: str, attributes: Sequence[str]) -> DataFrame:
    """(keys, first_day) of the entities whose snapshots differ between two sets, with the first day on which they do. A set has at
    most one snapshot a key and day; one that only one set has differs."""
    state = lambda df, name: df.select(*keys, day, F.struct(*attributes).alias(name), F.lit(True).alias(f"in_{name}"))
    both = state(old, "old").join(state(new, "new"), [*keys, day], "full")
    differ = F.col("in_old").isNull() | F.col("in_new").isNull() | ~F.col("old").eqNullSafe(F.col("new"))
    return both.where(differ).groupBy(*keys).agg(F.min(day).alias("first_day"))


def versions(snapshots: DataFrame, key: str, day: str, attributes: Sequence[str], least: Sequence[str] = (), seen: str | None = None) -> DataFrame:
    """(key, attributes, least, valid_from, valid_to, is_current) from one snapshot a key and day.

    A version begins where any attribute differs, null-safely, from the day before it in the snapshots, and ends where the
    next begins; the last is in force until FOREVER. ``least`` columns don't make versions; each keeps its least value.
    ``seen`` names a column of which a version has the first and last, as first_<seen> and last_<seen>. All of it needs one
    shuffle, by key; a key has at most one row a day.
    """
    order = Window.partitionBy(key).orderBy(day)
    state = F.struct(*attributes)
    island = F.sum(F.when(state.eqNullSafe(F.lag(state).over(order)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = snapshots.withColumn("island", island)
    extra = [F.min(seen).alias(f"first_{seen}"), F.max(seen).alias(f"last_{seen}")] if seen else []
    spans = marked.groupBy(key, "island").agg(
        *[F.first(a).alias(a) for a in attributes], *[F.min(c).alias(c) for c in least], *extra, F.min(day).cast("date").alias("valid_from"))
    until = F.coalesce(F.lead("valid_from").over(Window.partitionBy(key).orderBy("island")), F.lit(FOREVER).cast("date"))
    return spans.withColumn("valid_to", until).withColumn("is_current", F.col("valid_to") == F.lit(FOREVER).cast("date")).drop("island")


def as_of(facts: DataFrame, history: DataFrame, key: str, day: str, how: str = "inner") -> DataFrame:
    """Each fact with the version in force on its day: equal keys and valid_from <= day < valid_to. Versions of a key don't
    overlap, so a fact meets one at most; the range is a residual of the hash or merge join on the key."""
    f, h = facts.alias("f"), history.alias("h")
    match = (F.col(f"f.{key}") == F.col(f"h.{key}")) & (F.col("h.valid_from") <= F.col(f"f.{day}")) & (F.col("h.valid_to") > F.col(f"f.{day}"))
    added = [F.col(f"h.{c}") for c in history.columns if c != key and c not in facts.columns]
    return f.join(h, match, how).select("f.*", *added)


def version_at(history: DataFrame, key: str, value, day: str) -> DataFrame:
    """The version of one key on one day: no row or one."""
    on = F.lit(day).cast("date")
    return history.where((F.col(key) == F.lit(value)) & (F.col("valid_from") <= on) & (F.col("valid_to") > on))


def changes(history: DataFrame, key: str, attribute: str, version: str) -> DataFrame:
    """(key, <version>_before, <version>_after, before, after, changed_on) of neighbouring versions that touch and differ in
    ``attribute``: one window over the key instead of a self-join."""
    order = Window.partitionBy(key).orderBy("valid_from")
    previous = F.lag(F.struct(F.col(version).alias("v"), F.col(attribute).alias("a"), "valid_to")).over(order)
    paired = history.withColumn("previous", previous).where(
        (F.col("previous.valid_to") == F.col("valid_from")) & ~F.col("previous.a").eqNullSafe(F.col(attribute)))
    return paired.select(
        key, F.col("previous.v").alias(f"{version}_before"), F.col(version).alias(f"{version}_after"), F.col("previous.a").alias("before"),
        F.col(attribute).alias("after"), F.col("valid_from").alias("changed_on"))


def brand_changes(stations: DataFrame, brands: DataFrame) -> DataFrame:
    """Brand changes of stations with names and kind: to a brand, away from one, or between two."""
    b = brands.select("brand_key", "brand_name", "is_unbranded")
    was = b.select(F.col("brand_key").alias("before"), F.col("brand_name").alias("brand_before"), F.col("is_unbranded").alias("was_free"))
    now = b.select(F.col("brand_key").alias("after"), F.col("brand_name").alias("brand_after"), F.col("is_unbranded").alias("is_free"))
    kind = F.when(F.col("was_free") & ~F.col("is_free"), "bandeiramento").when(~F.col("was_free") & F.col("is_free"), "desbandeiramento").otherwise("troca de distribuidora")
    found = changes(stations, "cnpj", "brand_key", "station_key")
    return found.join(was, "before").join(now, "after").select(
        "cnpj", "station_key_before", "station_key_after", "brand_before", "brand_after", "changed_on", kind.alias("change_type"))
