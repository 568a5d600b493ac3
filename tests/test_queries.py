"""Every survey query against its SQL."""

import pytest
from comparing import differences, duck
from conftest import DATA

from tidemark.plans import registry


@pytest.fixture(scope="module")
def connection():
    return duck(f"{DATA}/sf0.01")


#: Queries that look for faults, of which there are none.
EMPTY = {"overlapping_versions", "unused_brand_anti_join"}


def test_only_checksums_lack_sql():
    assert registry.queries().keys() - registry.oracle_sql().keys() == {"file_checksum"}  # in test_warehouse.py


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query(spark, connection, name):
    sql = registry.oracle_sql()[name]
    assert not differences(registry.queries()[name](spark, f"{DATA}/sf0.01"), sql, connection)
    assert name in EMPTY or connection.sql(sql).limit(1).fetchall()


@pytest.mark.parametrize("name", ["asof_in_buckets", "event_effect_in_buckets", "placebo_in_buckets", "placebo_pairs_kept_in_buckets"])
def test_facts_in_buckets_stay_where_they_are(spark, name):
    """With joins that don't broadcast, no exchange lies above any scan of the facts and below the join that they enter, nor
    between it and the groups by station that follow."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()[name](spark, f"{DATA}/sf0.01")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    scans = [i for i, line in enumerate(plan) if "Scan parquet" in line and "sale_price" in line]
    assert len(scans) == (2 if name.startswith("placebo") else 1)
    for at in scans:
        assert "Bucketed: true" in plan[at]
        above, level = [], depth(plan[at])
        for line in reversed(plan[:at]):
            if depth(line) < level:
                above, level = [*above, line], depth(line)
        join = next(i for i, line in enumerate(above) if "Join" in line)
        grouped = [i for i, line in enumerate(above) if "Aggregate" in line][:2]  # in part and whole
        end = join if name == "asof_in_buckets" else grouped[1]
        assert end >= join and not [line for line in above[:end] if "Exchange" in line]
