"""Seconds of building the model's tables (once, cold), and median seconds of warm runs of what builds each of them and of the headline
queries; one line of JSON."""

import json
import os
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

from tidemark.operators.facts import build_facts, lowest_price
from tidemark.operators.rollup import weekly_rollup
from tidemark.plans import analog, registry

#: The five published questions first, then the operators under them.
HEADLINE = (
    "weekly_median_by_region", "dispersion_topk", "parity_monthly_two_level", "event_summary", "placebo_vs_event", "weekly_rollup", "event_effect", "weekly_change",
    "parity_weekly", "scd2_versions", "asof_fact_join", "distinct_on_min_price", "reject_classification", "duplicate_audit", "grain_check", "order_value_by_region",
)
#: What builds the tables that the questions read: versions from events, facts with their versions, the rollup of all facts.
BUILT = {
    "stations_built": analog.stations,
    "facts_built": lambda spark, folder: build_facts(lowest_price(analog.observations(spark, folder)), analog.model(spark, folder).stations),
    "rollup_built": lambda spark, folder: weekly_rollup(analog.model(spark, folder).facts, analog.model(spark, folder).stations),
}
RUNS = 2


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    began = time.perf_counter()
    analog.model(spark, folder)  # writes stations, facts and rollup, which the questions read
    took = {"build_model": round(time.perf_counter() - began, 3)}
    for name, query in {**BUILT, **{name: registry.queries()[name] for name in HEADLINE}}.items():
        seconds = []
        for _ in range(RUNS + 1):  # the first run reads cold files and compiles
            began = time.perf_counter()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        took[name] = round(median(seconds[1:]), 3)
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
