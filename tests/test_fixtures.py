"""Survey queries over small tables of their own, where the test tables can't show a fault."""

import datetime as dt
import itertools
import math
from decimal import Decimal

import pytest
from comparing import differences, duck
from pyspark.sql import functions as F

from tidemark.operators.clean import rejects
from tidemark.operators.event_study import before_after, effect
from tidemark.plans import registry
from tidemark.plans.warehouse import Warehouse
from tidemark.schemas import SURVEY_COLUMNS
from tidemark.storage import RuleBroken


@pytest.fixture
def few_stations(spark, tmp_path):
    """Brand X stands in city 24 only, no brand in city 7 only, brand Y nowhere."""
    tables = {
        "events": ([(1, 1, dt.datetime(2024, 1, 3), "view", 2.0), (2, 2, dt.datetime(2024, 1, 4), "error", 3.0)], "event_id long, user_id long, ts timestamp, event_type string, value double"),
        "customer": ([(1, "one", 24), (2, "two", 7)], "c_custkey long, c_name string, c_nationkey int"),
        "nation": ([(7, "N7", 0), (24, "N24", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R0")], "r_regionkey int, r_name string"),
    }
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_a_brand_of_any_city_is_in_use(spark, few_stations):
    assert [r.brand_name for r in registry.never_used_brands(spark, few_stations).collect()] == ["Y"]


def test_samples_of_rejects_need_no_sort_of_all(spark):
    """Each task hands on the first lines only, so no task gets every reject of a rule to rank."""
    rows = spark.range(0, 900, 1, 6).selectExpr("int(id % 2) source_file_id", "int(1000 - id) line_number", "'rule ' || id % 3 reject_rule", *[f"'x' {c}" for c in SURVEY_COLUMNS])
    found = rejects(rows.where("reject_rule <> 'rule 2'").unionByName(rows.where("reject_rule = 'rule 2'").withColumn("reject_rule", F.lit(None).cast("string"))), samples=5)
    got = found.collect()
    assert len(got) == 600
    for file in (0, 1):
        for rule in ("rule 0", "rule 1"):
            own = sorted((r.line_number, r.raw_row is not None) for r in got if (r.source_file_id, r.rule_name) == (file, rule))
            assert len(own) == 150 and [kept for _, kept in own] == [True] * 5 + [False] * 145
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def write_tables(spark, folder, events, customers):
    """Events as (user, time, kind, value), customers as (key, nation); ten nations of one region."""
    tables = {
        "events": ([(i, u, t, kind, v) for i, (u, t, kind, v) in enumerate(events)], "event_id long, user_id long, ts timestamp, event_type string, value double"),
        "customer": ([(k, f"c{k}", n) for k, n in customers], "c_custkey long, c_name string, c_nationkey int"),
        "nation": ([(n, f"N{n}", 0) for n in range(10)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R0")], "r_regionkey int, r_name string"),
    }
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).coalesce(1).toPandas().astype({"ts": "datetime64[us]"} if name == "events" else {}).to_parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_events_without_a_price_are_appended(spark, tmp_path):
    """An event's value may be 0 or missing: its fact is stored all the same, in both files. A surveyed price of 0 is refused as ever."""
    day = lambda n: dt.datetime(2024, 1, n, 12)
    folder = write_tables(spark, tmp_path, [(1, day(3), "view", 0.0), (1, day(22), "view", 0.0), (1, day(22), "purchase", None), (1, day(25), "view", 4.5), (1, day(25), "view", -1.0)], [(1, 2)])
    assert not differences(registry.queries()["fact_append"](spark, folder), registry.oracle_sql()["fact_append"], duck(folder))
    house = Warehouse(spark, f"file://{tmp_path}/w")
    prices = spark.createDataFrame([("0" * 14, dt.date(2024, 1, 3), 1, 0, 1)], "cnpj string, collection_date date, product_key short, sale_price int, source_file_id int")
    versions = spark.createDataFrame([("0" * 14, 5, dt.date(2024, 1, 1), dt.date(9999, 12, 31))], "cnpj string, station_key long, valid_from date, valid_to date").withColumn("bucket", house.bucket())
    with pytest.raises(RuleBroken, match="plausible"), house.tables.transaction() as t:
        t.replace("stations", versions, ("bucket",))
        house.add_facts(t, prices, 1, [])


def test_means_are_the_same_in_any_order_of_rows(spark):
    """Stations whose prices are the same on both sides, in another order each, have neither risen nor fallen alike: sums in the order of
    arrival differ in their last bit. The market's mean of several weeks is taken in the same way."""
    prices = (Decimal("0.1"), Decimal("0.2"), Decimal("0.3"), Decimal("99999.999"), Decimal("0.001"))
    expected = math.fsum(map(float, prices)) / len(prices)
    orders = list(itertools.permutations(prices))
    rows = [(n, phase, p) for n, order in enumerate(orders) for phase, own in (("before", order), ("after", reversed(order))) for p in own]
    seen = spark.createDataFrame(rows, "station int, phase string, sale_price decimal(8,3)").coalesce(1)
    got = before_after(seen, ["station"], 5).collect()
    assert len(got) == len(orders) and {(r.price_before, r.price_after) for r in got} == {(expected, expected)}
    three = before_after(seen.withColumn("times", F.lit(3)), ["station"], 15, "times").collect()
    assert len(three) == len(orders) and {(r.price_before, r.price_after, r.obs_after) for r in three} == {(math.fsum(map(float, prices * 3)) / 15,) * 2 + (15,)}
    monday, weeks = dt.date(2024, 3, 4), [dt.timedelta(weeks=w) for w in range(-5, 5)]
    cases = spark.createDataFrame([(n, 1, monday, 1.0, 1.0) for n in range(len(orders))], "city_key int, product_key int, day date, price_before double, price_after double")
    medians = [(n, 1, monday + w, p) for n, order in enumerate(orders) for w, p in zip(weeks, (*order, *reversed(order)), strict=True)]
    weekly = spark.createDataFrame(medians, "city_key int, product_key int, week_start_date date, median_price decimal(8,3)").coalesce(1)
    assert [r.excess_change for r in effect(cases, weekly, "day", 35).collect()] == [0.0] * len(orders)
