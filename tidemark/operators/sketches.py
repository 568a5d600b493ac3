"""Profiles that merge: each part of the data leaves a few small rows, and the profile of any parts together is made of those.

Numbers of different values are HyperLogLog sketches, quantiles are KLL sketches; counts, extremes and what is known of each entity
merge exactly, and so do numbers of different values if the parts keep these, too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch of different values, as a logarithm: a standard error of 1.04 / sqrt(2 ** LG_K), 0.4 %; up to some thousand values it has each.
LG_K = 16
#: Size of a quantile sketch: ranks are off by 0.7 % at most, 99 times in 100.
KLL = 400

COLUMN_SKETCH = "column string, rows long, missing long, different binary, least string, highest string"
NUMBER_SKETCH = "column string, numbers long, total double, low double, high double, quantiles binary"


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))


def _unfolded(one: DataFrame, names: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """A row a column of a single row whose columns are named name|kind."""
    fields = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{k}`").alias(k) for k in kinds]) for c in names]
    return one.select(F.explode(F.array(*fields)).alias("c")).select("c.*")


def sketch_columns(rows: DataFrame, names: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """COLUMN_SKETCH of text columns, blank text counting as missing: one pass, a row a column."""
    aggregates: list[Column] = []
    for c in names:
        text = _text(c)
        aggregates += [F.count(F.lit(1)).alias(f"{c}|rows"), F.count_if(text.isNull()).alias(f"{c}|missing"), F.hll_sketch_agg(text, lg_k).alias(f"{c}|different"), F.min(text).alias(f"{c}|least"), F.max(text).alias(f"{c}|highest")]
    return _unfolded(rows.agg(*aggregates), names, ("rows", "missing", "different", "least", "highest"))


def merge_columns(sketches: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(column, rows, missing, distinct_values, least, highest) of all parts together. Distinct values are counted exactly if ``values``
    has those of the parts, as (column, value), else estimated."""
    if values is not None:
        exact = values.groupBy("column").agg(F.count_distinct("value").alias("distinct_values"))
        merged = sketches.groupBy("column").agg(*[f(c).alias(c) for c, f in (("rows", F.sum), ("missing", F.sum), ("least", F.min), ("highest", F.max))])
        return merged.join(exact, "column", "left").select("column", "rows", "missing", F.coalesce("distinct_values", F.lit(0).cast("long")).alias("distinct_values"), "least", "highest")
    return sketches.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.round(F.hll_sketch_estimate(F.hll_union_agg("different"))).cast("long").alias("distinct_values"),
        F.min("least").alias("least"), F.max("highest").alias("highest"))


def sketch_numbers(rows: DataFrame, numbers: dict[str, Column]) -> DataFrame:
    """NUMBER_SKETCH of numbers by name: one pass, a row a name."""
    aggregates: list[Column] = []
    for name, value in numbers.items():
        x = value.cast("double")
        aggregates += [F.count(x).alias(f"{name}|numbers"), F.sum(x).alias(f"{name}|total"), F.min(x).alias(f"{name}|low"), F.max(x).alias(f"{name}|high"), F.kll_sketch_agg_double(x, KLL).alias(f"{name}|quantiles")]
    return _unfolded(rows.agg(*aggregates), list(numbers), ("numbers", "total", "low", "high", "quantiles"))


def merge_numbers(sketches: DataFrame, shares: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(column, numbers, mean, low, high, quantiles) of all parts together; no quantiles where there are no numbers."""
    merged = sketches.where("numbers > 0").groupBy("column").agg(
        F.sum("numbers").alias("numbers"), (F.sum("total") / F.sum("numbers")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("quantiles", KLL).alias("sketch"))
    at = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(s)) for s in shares])
    return merged.select("column", "numbers", "mean", "low", "high", at.alias("quantiles"))


def value_counts(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, value, rows) of columns, a row a different value; blank ones are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _text(c).alias("value")) for c in names]))
    return rows.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


def summarise_entities(rows: DataFrame, key: Column, attributes: dict[str, Column]) -> DataFrame:
    """(entity, <attribute>_least, <attribute>_most) of each entity: enough to tell, over any parts, whether it ever differed."""
    kept = rows.select(key.alias("entity"), *[c.alias(a) for a, c in attributes.items()]).where("entity is not null and entity <> ''")
    return kept.groupBy("entity").agg(*[f(a).alias(f"{a}_{n}") for a in attributes for n, f in (("least", F.min), ("most", F.max))])


def entity_changes(summaries: DataFrame, part: str, parts: int, attributes: Sequence[str]) -> DataFrame:
    """(attribute, entities, in_all, changing): entities of all parts, those that stand in every one of the ``parts``, and of these how many
    had more than one value of the attribute."""
    merged = summaries.groupBy("entity").agg(F.count_distinct(part).alias("parts"), *[(F.min(f"{a}_least") < F.max(f"{a}_most")).alias(a) for a in attributes])
    everywhere = F.col("parts") == parts
    one = merged.agg(F.count(F.lit(1)).alias("entities"), F.count_if(everywhere).alias("in_all"), *[F.count_if(everywhere & F.col(a)).alias(a) for a in attributes])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), "entities", "in_all", F.col(a).alias("changing")) for a in attributes])).alias("r")).select("r.*")
