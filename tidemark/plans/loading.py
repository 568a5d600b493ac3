"""Queries over survey files and the warehouse that they are loaded into, and over its control tables.

The files are synthesised: the dirty rows of ``analog.raw_survey`` as text, with marks in the header, a byte order mark,
quoted fields and lines that lack a field. They and the warehouses are written once for each state of the input and of this code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import quarter
from tidemark.operators import checks
from tidemark.operators.clean import clean
from tidemark.operators.facts import lowest_price
from tidemark.operators.history import version_at, versions
from tidemark.operators.keys import merge_brand, review, unused_brands
from tidemark.plans import ops
from tidemark.plans.analog import model, observations, raw_products, raw_survey, table
from tidemark.plans.reports import SourceProfile
from tidemark.plans.warehouse import FACT_RULES, Warehouse
from tidemark.schemas import CALENDAR, STATION, SURVEY_COLUMNS
from tidemark.sources import seeds
from tidemark.sources.byte_ranges import checksums
from tidemark.sources.survey_files import check_header, header_of, numbered_records, read_survey
from tidemark.storage import Conflict, Tables, derived_dir

# The header cells of a survey file.
HEADER = (
    "Região - Sigla", "Estado - Sigla", "Município", "Revenda", "CNPJ da Revenda", "Nome da Rua", "Número Rua", "Complemento",
    "Bairro", "CEP", "Produto", "Data da Coleta", "Valor de Venda", "Valor de Compra", "Unidade de Medida", "Bandeira",
)
#: Events whose line lacks a field, and those whose fields are quoted.
SHORT_EVERY, SHORT_AT, QUOTED_EVERY = 67, 11, 4
NOW = "1998-08-02 12:00:00"
#: What facts made of events must hold: an event's value may be any, 0 too, which no surveyed price is.
EVENT_RULES = {k: v for k, v in FACT_RULES.items() if k != "facts are plausible"} | {"facts are dated well": f"collection_date BETWEEN DATE '{CALENDAR[0]}' AND DATE '{CALENDAR[1]}'"}


def survey_lines(rows: DataFrame) -> DataFrame:
    """(line_number, value) of the file that holds raw rows."""
    event = F.col("line_number") - 2
    field = lambda c: F.coalesce(F.col(c), F.lit(""))
    quoted = lambda c: F.when(event % QUOTED_EVERY == 0, F.concat(F.lit('"'), field(c), F.lit('"'))).otherwise(field(c))
    whole = F.concat_ws(";", *map(quoted, SURVEY_COLUMNS))
    short = F.concat_ws(";", *map(quoted, SURVEY_COLUMNS[:-1]))
    body = rows.select("line_number", F.when(event % SHORT_EVERY == SHORT_AT, short).otherwise(whole).alias("value"))
    return body.unionByName(rows.sparkSession.range(1).select(F.lit(1).alias("line_number"), F.lit("﻿" + ";".join(HEADER)).alias("value")))


def spoilt_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows as a first file had them, before it was corrected: prices, brands and products that are others, rows that are too
    many, and a file that ends early."""
    rows, event = raw_survey(spark, sf_dir), F.col("line_number") - 2
    user = F.col("cnpj_da_revenda").substr(-5, 5)
    return rows.where((event % 19 != 6) & (event % 23 != 7)).withColumns({
        "valor_de_venda": F.when(event % 7 == 3, F.concat(F.col("valor_de_venda"), F.lit("1"))).otherwise(F.col("valor_de_venda")),
        "bandeira": F.when(event % 11 == 4, F.lit("BRANCA")).otherwise(F.col("bandeira")),
        "produto": F.when(event % 13 == 5, F.lit("??")).otherwise(F.col("produto")),
        "data_da_coleta": F.when((event % 17 == 2) & user.isNotNull(), F.lit("05/02/2024")).otherwise(F.col("data_da_coleta"))})


#: The files that are synthesised, by name.
FILES = {"survey": raw_survey, "spoilt": spoilt_survey}


def survey_file(spark: SparkSession, sf_dir: str, name: str = "survey") -> str:
    """The folder of parts that is the file, written if need be."""
    tables = Tables(spark, derived_dir(spark, name, f"{sf_dir}/events.parquet"))
    if not tables.has("file"):
        lines = survey_lines(FILES[name](spark, sf_dir)).repartitionByRange(4, "line_number").sortWithinPartitions("line_number")
        try:
            with tables.transaction() as t:
                t.put_files("file", lambda path: lines.select("value").write.text(path))
        except Conflict:
            pass  # another session has written the same
    return tables.snapshot().folders("file")[0]


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_survey(spark, survey_file(spark, sf_dir), 1)


def file_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the file with the first rule that it breaks."""
    cleaned = clean(_read(spark, sf_dir), raw_products(spark))
    price = F.when(F.col("reject_rule").isNull(), F.col("sale_price").cast("double"))
    return cleaned.select("line_number", "reject_rule", F.when(F.col("reject_rule").isNull(), F.col("cnpj")).alias("cnpj"), price.alias("sale_price"))


def file_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file's columns in order, after the check against those expected."""
    found = header_of(numbered_records(spark, survey_file(spark, sf_dir)), ";")
    check_header(found, SURVEY_COLUMNS, "survey")
    return spark.createDataFrame(list(enumerate(found, 1)), "place int, name string")


def file_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of an input table's file."""
    return checksums(spark, f"{sf_dir}/region.parquet").select("bytes", "sha256")


def loaded(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The warehouse with the file loaded and the rollup refreshed."""
    house = Warehouse(spark, derived_dir(spark, "warehouse", f"{sf_dir}/events.parquet"), raw_products(spark))
    if not house.tables.has("weekly"):
        house.load(1, survey_file(spark, sf_dir))
        house.refresh()
    return house


def reloaded(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The warehouse once the spoilt file was loaded and the rollup made, then the corrected one with its prices, and the rollup brought up to date."""
    house = Warehouse(spark, derived_dir(spark, "reloaded", f"{sf_dir}/events.parquet"), raw_products(spark))
    if not house.tables.has("weekly"):
        house.load(1, survey_file(spark, sf_dir, "spoilt"))
        house.refresh()
    if house.catalog().where("sha256 is not null").count() and house.runs().where("stage = 'facts'").count() < 2:
        house.load(1, survey_file(spark, sf_dir), replace_prices=True)
        house.refresh()
    return house


def reload_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and the versions that they point to after a corrected file was loaded again: as if it had come alone."""
    house = reloaded(spark, sf_dir)
    versions_ = house.stations().select("station_key", "valid_from", "valid_to", "last_seen_file")
    return house.facts().join(versions_, "station_key").select("cnpj", "product_key", "collection_date", F.col("sale_price").cast("double").alias("sale_price"), "quarter", "valid_from", "valid_to", "last_seen_file")


def reload_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects by rule after a corrected file was loaded again: none of the first file's stays."""
    return reloaded(spark, sf_dir).rejects().groupBy("source_file_id", "rule_name").agg(F.count(F.lit(1)).alias("rejects"), F.count("raw_row").alias("samples"))


def reload_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup after only the quarters that a corrected file has changed were computed anew."""
    return _named_rollup(reloaded(spark, sf_dir))


def reject_samples_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the sample rows that rejects keep as JSON."""
    rows = loaded(spark, sf_dir).rejects().where("raw_row is not null")
    at = lambda name: F.get_json_object("raw_row", f"$.{name}").alias(name)
    return rows.select("line_number", "rule_name", at("cnpj_da_revenda"), at("produto"), at("data_da_coleta"), at("valor_de_venda"), F.coalesce(F.json_object_keys("raw_row"), F.array()).alias("k")).withColumn("fields", F.size("k")).drop("k")


def warehouse_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    house = loaded(spark, sf_dir)
    brands = house.model().brands.select("brand_key", "brand_name")
    state_ = F.col("attribute_hash") == F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("legal_name", "brand_key", "city_key", "street", "street_number", "district", "zip_code")]))
    return house.stations().join(brands, "brand_key").select("cnpj", "legal_name", "brand_name", "zip_code", "valid_from", "valid_to", "is_current", "first_seen_file", "last_seen_file", state_.alias("hash_holds"))


def warehouse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    house = loaded(spark, sf_dir)
    versions_ = house.stations().select("station_key", "valid_from")
    return house.facts().join(versions_, "station_key").select("cnpj", "product_key", "collection_date", F.col("sale_price").cast("double").alias("sale_price"), "quarter", "valid_from")


def _named_rollup(house: Warehouse) -> DataFrame:
    m = house.model()
    named = m.weekly.join(m.cities.select("city_key", "city_name"), "city_key")
    return named.select("survey_week_key", "city_name", "product_key", "observations", F.col("median_price").cast("double").alias("median_price"))


def warehouse_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named_rollup(loaded(spark, sf_dir))


def warehouse_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the catalog after the load, and the runs of each kind."""
    house = loaded(spark, sf_dir)
    runs = house.runs().groupBy("source_file_id", "stage").agg(F.max("status").alias("run_status"), F.max("rows_in").alias("rows_in"), F.max("rows_rejected").alias("rows_rejected"))
    return house.catalog().join(runs, "source_file_id", "left").select("half_year", "status", "stage", "run_status", "rows_in", "rows_rejected", F.length("sha256").alias("sha256_chars"))


def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: open, finished or failed by their status; some without rows."""
    key, begun = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    running = F.col("o_orderstatus") == "O"
    return table(spark, sf_dir, "orders").select(
        key.cast("long").alias("run_id"), (F.col("o_custkey") % 9 + 1).cast("int").alias("source_file_id"), F.col("o_orderpriority").alias("stage"),
        F.when(running, "running").when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("status"), begun.alias("started_at"),
        F.when(~running, F.timestamp_seconds(F.unix_timestamp(begun) + (key % 50) * 60)).alias("finished_at"), (key % 5 * 100).cast("long").alias("rows_in"),
        (key % 5 * 90).cast("long").alias("rows_out"), (key % 5 * 10 + key % 3).cast("long").alias("rows_rejected"), F.lit(None).cast("string").alias("message"))


def load_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.load_health(run_ledger(spark, sf_dir), seeds.catalog(spark))
    return found.select("run_id", "half_year", "stage", "status", F.date_format("started_local", "yyyy-MM-dd HH:mm:ss").alias("started_local"), "seconds", "rows_in", "rows_rejected", "pct_rejected")


def stuck_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stuck_runs(run_ledger(spark, sf_dir), now=NOW).select("run_id", "source_file_id", "stage", "minutes")


def _number(cnpj: str = "cnpj") -> Column:
    return F.col(cnpj).cast("long")


def station_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of one station on one day."""
    return version_at(model(spark, sf_dir).stations, "cnpj", f"{7:014d}", "2024-01-16").select("cnpj", "brand_key", "valid_from", "valid_to")


def brand_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands with their stations and renamed aliases after Y went into X."""
    m = model(spark, sf_dir)
    names = m.brands.withColumn("reviewed_at", F.lit(None).cast("timestamp"))
    aliases = names.select(F.col("brand_name").alias("alias_text"), "brand_key", F.lit(False).alias("is_rename"), F.lit(None).cast("string").alias("note"))
    brands, aliases, stations = merge_brand(names, aliases, m.stations, "Y", "X")
    renamed = aliases.groupBy("brand_key").agg(F.count(F.lit(1)).alias("aliases"), F.count_if("is_rename").alias("renames"))
    held = stations.groupBy("brand_key").agg(F.count(F.lit(1)).alias("versions"))
    return brands.join(renamed, "brand_key", "left").join(held, "brand_key", "left").select("brand_name", "aliases", "renames", F.coalesce("versions", F.lit(0)).alias("versions"))


def brand_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that lack a review once X has had one."""
    brands = model(spark, sf_dir).brands.withColumns({"needs_review": F.col("brand_name") != "Y", "reviewed_at": F.lit(None).cast("timestamp")})
    return review(brands, ["X"]).select("brand_name", "needs_review", F.col("reviewed_at").isNotNull().alias("is_reviewed"))


def version_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states of a customer as versions, each with its least priority, which makes no version."""
    daily = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.min("o_orderstatus").alias("state"), F.min("o_orderpriority").alias("priority"))
    return versions(daily, "o_custkey", "day", ["state"], ["priority"]).select("o_custkey", "state", "priority", "valid_from", "valid_to")


def fact_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that a second file adds to those of the first 20 days: grains that are there are ignored, whatever their price."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("events", "customer")]
    house = Warehouse(spark, derived_dir(spark, "append", *inputs), raw_products(spark), fact_rules=EVENT_RULES)
    if not house.tables.has("facts"):
        versions_, prices = model(spark, sf_dir).stations, lowest_price(observations(spark, sf_dir))
        missing = [c for c in STATION.split(", ") if c.split()[0] not in versions_.columns]
        whole = versions_.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in missing}).withColumn("bucket", house.bucket())
        with house.tables.transaction() as t:
            t.replace("stations", whole, ("bucket",))
            for file, part in ((1, prices.where("collection_date < date'2024-01-21'")), (2, prices.withColumn("sale_price", (F.col("sale_price") + 1).cast("decimal(8,3)")))):
                house.add_facts(t, part.withColumn("source_file_id", F.lit(file)), file, ["2024q1"])
    return house.facts().where("source_file_id = 2").groupBy("product_key", "quarter").agg(F.count(F.lit(1)).alias("added"))


def partition_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions once errors were dated four years on, past the last quarter that there is."""
    facts = model(spark, sf_dir).facts
    day = F.when(F.col("product_key") == 2, F.add_months("collection_date", 48)).otherwise(F.col("collection_date"))
    return ops.partition_health(facts.withColumn("collection_date", day).withColumn("quarter", quarter(F.col("collection_date"))))


def unused_part_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no line has in full lots of 50."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("brand_key"), "p_name")
    lots = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("brand_key"))
    return unused_brands(parts, lots).select(F.col("brand_key").alias("p_partkey"), "p_name")


def broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break each structural rule, after faults of each kind were planted."""
    m, n = model(spark, sf_dir), _number()
    spoilt = m.stations.withColumns({
        "valid_to": F.when((n % 5 == 0) & ~F.col("is_current"), F.date_add("valid_to", 7)).when((n % 5 == 1) & ~F.col("is_current"), F.lit("9999-12-31").cast("date")).otherwise(F.col("valid_to")),
        "is_current": F.col("is_current") | (n % 7 == 2), "brand_key": F.when(n % 11 == 3, 99).otherwise(F.col("brand_key")), "cnpj": F.when(n % 13 == 4, F.substring("cnpj", 2, 13)).otherwise(F.col("cnpj"))})
    facts = m.facts.withColumns({
        "sale_price": F.when(n % 17 == 5, 0).otherwise(F.col("sale_price")).cast("decimal(8,3)"), "station_key": F.when(n % 19 == 6, -1).otherwise(F.col("station_key")),
        "collection_date": F.when(n % 23 == 7, F.lit("2024-01-09").cast("date")).otherwise(F.col("collection_date"))})
    aliases = m.brands.select(F.col("brand_name").alias("alias_text"), (F.col("brand_key") + 1).alias("brand_key"))
    found = checks.broken(spoilt, facts, m.brands, m.cities.where("city_key <> 3"), aliases)
    counts = None
    for rule, rows in found.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(rule).alias("rule"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def profiled(spark: SparkSession, sf_dir: str) -> SourceProfile:
    """The stored profiles of the spoilt file and the corrected one."""
    profile = SourceProfile(spark, derived_dir(spark, "profile", f"{sf_dir}/events.parquet"))
    for file, name in enumerate(FILES, 1):
        if not profile.files().where(F.col("file") == file).count():
            profile.add(file, survey_file(spark, sf_dir, name))
    return profile


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of both files together, from stored sketches."""
    return profiled(spark, sf_dir).columns().where(F.col("column").isin("cnpj_da_revenda", "produto", "bandeira", "cep", "valor_de_compra"))


def profile_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiled(spark, sf_dir).values()


def profile_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiled(spark, sf_dir).changes()


def profile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file looks like, and what its rows say of themselves."""
    return profiled(spark, sf_dir).files().select("file", "encoding", "delimiter", F.size("columns").alias("columns"), "rows", "masked", "first_day", "last_day")


QUERIES = {
    "file_ingest": file_ingest, "file_header": file_header, "file_checksum": file_checksum, "warehouse_stations": warehouse_stations, "warehouse_facts": warehouse_facts,
    "warehouse_rollup": warehouse_rollup, "warehouse_catalog": warehouse_catalog, "load_health": load_health, "stuck_runs": stuck_runs, "station_lookup": station_lookup,
    "brand_merge": brand_merge, "brand_review": brand_review, "version_least": version_least, "fact_append": fact_append, "broken_rules": broken_rules,
    "reload_changes": reload_changes, "reload_rejects": reload_rejects, "reload_rollup": reload_rollup, "reject_samples_json": reject_samples_json,
    "profile_columns": profile_columns, "profile_values": profile_values, "profile_changes": profile_changes, "profile_files": profile_files,
    "partition_anomalies": partition_anomalies, "unused_part_anti_join": unused_part_anti_join,
}
