"""The survey model over the test tables: users are stations, event types products, nations cities, regions states.

A user's brand in a week is the kind of its first event in it: an error leaves it without a brand, a sign-up is brand Y,
anything else brand X.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import week_start
from tidemark.operators.facts import lowest_price
from tidemark.operators.history import versions
from tidemark.plans.model import Model
from tidemark.plans.warehouse import written_model
from tidemark.sources.bucketed import read_buckets, write_buckets
from tidemark.storage import Conflict, Tables, derived_dir

#: Event types by product key, from 1.
TYPES = ("click", "error", "purchase", "signup", "view")
GASOLINE, ETHANOL = 3, 5
UNBRANDED, BRAND_Y, BRAND_X = 1, 2, 3
#: Half width of an event window and least observations of a phase: the events span a month only.
DAYS, LEAST = 7, 2


#: Columns of the tables that every question meets: Spark need not open a file, and run a job, to find them out.
SCHEMAS = {"nation": "n_nationkey int, n_name string, n_regionkey int", "region": "r_regionkey int, r_name string"}
VERSION = "station_key long, cnpj string, legal_name string, brand_key int, city_key int, valid_from date, valid_to date, is_current boolean, district string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def product_of(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TYPES)), kind).cast("smallint")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as prices, repeated grains and all."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.lpad(F.col("user_id").cast("string"), 14, "0").alias("cnpj"), F.col("user_id"), F.col("ts").cast("date").alias("collection_date"),
        product_of(F.col("event_type")).alias("product_key"), F.col("value").cast("decimal(8,3)").alias("sale_price"), F.lit(1).alias("source_file_id"),
        "event_type", F.struct("ts", "event_id").alias("moment"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    brand = F.when(kind == "error", UNBRANDED).when(kind == "signup", BRAND_Y).otherwise(BRAND_X)
    weekly = observations(spark, sf_dir).groupBy("cnpj", "user_id", week_start(F.col("collection_date")).alias("day")).agg(F.min_by("event_type", "moment").alias("event_type"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("legal_name"), F.col("c_nationkey").alias("city_key"))
    snapshots = weekly.join(customers, "user_id").withColumn("brand_key", brand)
    spans = versions(snapshots, "cnpj", "day", ["legal_name", "brand_key", "city_key"])
    return spans.select(F.xxhash64("cnpj", "valid_from").alias("station_key"), "*", F.lit(None).cast("string").alias("district"))


def model(spark: SparkSession, sf_dir: str) -> Model:
    """Stations, facts and rollup are written once for each state of the input tables and of this code, and read by every question."""
    folder = derived_dir(spark, "model", *[f"{sf_dir}/{t}.parquet" for t in ("events", "customer")])
    facts, versions_, weekly = written_model(spark, folder, lambda: stations(spark, sf_dir), lambda: lowest_price(observations(spark, sf_dir)), VERSION)
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    cities = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select(
        F.col("n_nationkey").alias("city_key"), F.col("n_name").alias("city_name"), F.col("r_name").alias("uf"), F.substring("r_name", 1, 2).alias("region"))
    products = spark.range(1, len(TYPES) + 1).select(
        F.col("id").cast("smallint").alias("product_key"), F.element_at(F.array(*map(F.lit, TYPES)), F.col("id").cast("int")).alias("product_name"),
        F.lit("event").alias("fuel_family"), F.lit("1").alias("unit_of_measure"), (F.col("id") != 2).alias("is_liquid_fuel"), F.lit(True).alias("in_default_scope"))
    names = F.array(F.lit("UNBRANDED"), F.lit("Y"), F.lit("X"))
    brands = spark.range(1, 4).select(F.col("id").cast("int").alias("brand_key"), F.element_at(names, F.col("id").cast("int")).alias("brand_name"), (F.col("id") == UNBRANDED).alias("is_unbranded"), F.lit(False).alias("needs_review"))
    return Model(facts, versions_, cities, products, brands, ("2024-01-01", "2024-12-31"), weekly)


#: Buckets of the tables by station: about one for each 128 MB of facts, fixed when they are written.
BUCKETS = 8


def bucketed_model(spark: SparkSession, sf_dir: str) -> Model:
    """The model with its facts and stations in buckets by cnpj, written once for each state of the input and of this code."""
    m = model(spark, sf_dir)
    tables = Tables(spark, derived_dir(spark, "buckets", *[f"{sf_dir}/{t}.parquet" for t in ("events", "customer")]))
    found = {"facts": m.facts, "stations": m.stations}
    if not tables.has("facts"):
        try:
            with tables.transaction() as t:
                for name, df in found.items():
                    t.put_files(name, lambda path, df=df: write_buckets(df, path, "cnpj", BUCKETS))
        except Conflict:
            pass  # another session has written the same
    now = tables.snapshot()
    stored = {name: read_buckets(spark, now.folders(name)[0], df.schema, "cnpj", BUCKETS) for name, df in found.items()}
    return replace(m, **stored)


def raw_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw survey rows, with dirt of each kind by the event's number."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    day, value = F.date_format("ts", "dd/MM/yyyy"), F.replace(F.col("value").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))
    every = lambda k, at, wrong, right: F.when(n % k == at, wrong).otherwise(right)
    blank = F.lit(None).cast("string")
    cnpj = F.lpad(F.col("user_id").cast("string"), 14, "0")
    rows = e.select(
        F.lit(1).alias("source_file_id"), (n + 2).cast("int").alias("line_number"), F.lit("se").alias("regiao_sigla"),
        every(31, 5, F.lit("S1"), F.lit(" sp ")).alias("estado_sigla"), F.concat(F.lit("CITY  "), (F.col("user_id") % 25).cast("string")).alias("municipio"),
        every(37, 3, F.lit("  "), F.concat(F.lit(" posto   "), F.col("user_id").cast("string"))).alias("revenda"),
        every(41, 7, blank, every(43, 9, F.lit("12.3"), F.concat(F.substring(cnpj, 1, 8), F.lit("/"), F.substring(cnpj, 9, 6)))).alias("cnpj_da_revenda"),
        F.lit("rua a").alias("nome_da_rua"), F.lit("10").alias("numero_rua"), blank.alias("complemento"), F.lit("centro").alias("bairro"),
        every(3, 0, F.lit("01310-100"), F.lit("123")).alias("cep"), F.upper("event_type").alias("produto"),
        every(47, 1, F.lit("31/02/2024"), every(53, 2, F.lit("15/03/2019"), day)).alias("data_da_coleta"),
        every(59, 4, F.lit("1.234,56"), value).alias("valor_de_venda"), blank.alias("valor_de_compra"), F.lit("R$ / litro").alias("unidade_de_medida"),
        every(5, 0, F.lit("vibra  energia"), every(5, 1, F.lit("BRANCA"), every(5, 2, blank, F.concat(F.lit("novo "), (F.col("user_id") % 3).cast("string"))))).alias("bandeira"))
    names = [c for c in rows.columns if c not in ("source_file_id", "line_number")]
    empty = (F.col("line_number") - 2) % 61 == 8
    return rows.withColumns({c: F.when(~empty, F.col(c)) for c in names})


def raw_products(spark: SparkSession) -> DataFrame:
    """Products of the raw rows: clicks are unknown."""
    return spark.range(2, len(TYPES) + 1).select(F.col("id").cast("smallint").alias("product_key"), F.upper(F.element_at(F.array(*map(F.lit, TYPES)), F.col("id").cast("int"))).alias("source_product_name"))
