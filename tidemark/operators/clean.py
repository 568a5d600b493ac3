"""Cleaning of survey rows: normal forms, and the first rule that a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import digits, normal, normal_or_null, parse_date, parse_price
from tidemark.schemas import CALENDAR, MAX_PRICE, REJECT_SAMPLES, SURVEY_COLUMNS


def rules(calendar: tuple[str, str] = CALENDAR, max_price: float = MAX_PRICE) -> list[tuple[str, Column]]:
    """Names and conditions of the rules; a row gets the first that holds, so the general ones come first."""
    day, value = F.col("collection_date"), F.col("sale_price")
    first, last = (F.lit(d).cast("date") for d in calendar)
    return [
        ("field_count", F.coalesce(F.col("is_malformed"), F.lit(False))),
        ("empty_row", F.col("is_blank")),
        ("cnpj_missing", F.col("cnpj_digits") == ""),
        ("cnpj_length", F.length("cnpj_digits") != 14),
        ("date_unparseable", day.isNull()),
        ("date_out_of_calendar", ~day.between(first, last)),
        ("price_unparseable", value.isNull()),
        ("price_out_of_range", (value <= 0) | (F.col("price_read") > max_price) | (value > max_price)),
        ("product_unknown", F.col("product_key").isNull()),
        ("uf_invalid", ~F.col("uf").rlike("^[A-Z]{2}$")),
        ("legal_name_empty", F.col("legal_name") == ""),
    ]


def clean(raw: DataFrame, products: DataFrame, calendar: tuple[str, str] = CALENDAR, max_price: float = MAX_PRICE) -> DataFrame:
    """raw with normal columns and ``reject_rule``, null where a row can be loaded.

    Prices are read wide and range-checked after rounding to three decimals, so what passes also fits the fact. ``raw`` may
    mark rows of a wrong number of fields in ``is_malformed``.
    """
    malformed = F.col("is_malformed") if "is_malformed" in raw.columns else F.lit(False)
    cnpj, zip_code, read = digits(F.col("cnpj_da_revenda")), digits(F.col("cep")), parse_price(F.col("valor_de_venda"))
    rounded = F.when(F.abs(read) < 100_000, F.round(read, 3)).otherwise(read)
    normals = raw.select(
        *raw.columns, malformed.alias("is_malformed_"), (F.trim(F.concat_ws("", *SURVEY_COLUMNS)) == "").alias("is_blank"), cnpj.alias("cnpj_digits"),
        F.when(F.length(cnpj) == 14, cnpj).alias("cnpj"), parse_date(F.col("data_da_coleta")).alias("collection_date"), read.alias("price_read"),
        rounded.alias("sale_price"), normal(F.col("revenda")).alias("legal_name"), F.coalesce("bandeira", F.lit("")).alias("brand_raw"),
        normal(F.col("municipio")).alias("city_name"), F.upper(F.trim(F.coalesce("estado_sigla", F.lit("")))).alias("uf"),
        F.upper(F.trim(F.coalesce("regiao_sigla", F.lit("")))).alias("region"), normal_or_null(F.col("nome_da_rua")).alias("street"),
        F.nullif(F.upper(F.trim(F.coalesce("numero_rua", F.lit("")))), F.lit("")).alias("street_number"), normal_or_null(F.col("bairro")).alias("district"),
        F.when(F.length(zip_code) == 8, zip_code).alias("zip_code"), normal_or_null(F.col("complemento")).alias("complement_"),
        normal(F.col("produto")).alias("product_name_src"))
    normals = normals.drop("is_malformed").withColumnRenamed("is_malformed_", "is_malformed").withColumnRenamed("complement_", "complement")
    known = products.select(F.col("source_product_name").alias("product_name_src"), "product_key")
    joined = normals.join(known, "product_name_src", "left")
    broken = F.lit(None).cast("string")
    for name, condition in reversed(rules(calendar, max_price)):
        broken = F.when(condition, F.lit(name)).otherwise(broken)
    return joined.withColumn("reject_rule", broken)


def accepted(cleaned: DataFrame) -> DataFrame:
    """Rows to load, in the clean schema; the price is cut to its storage type."""
    return cleaned.where("reject_rule is null").select(
        "source_file_id", "line_number", "cnpj", "collection_date", F.col("sale_price").cast("decimal(8,3)").alias("sale_price"), "legal_name", "brand_raw",
        "city_name", "uf", "region", "street", "street_number", "district", "zip_code", "complement", "product_key")


def rejects(cleaned: DataFrame, samples: int = REJECT_SAMPLES) -> DataFrame:
    """One row a rejected row, with what was wrong; the first ``samples`` lines of a file and rule also keep the row as JSON.

    The first lines are found with a limit in each task before rows are dealt by file and rule, and joined back.
    """
    bad = cleaned.where("reject_rule is not null")
    detail = F.format_string(
        "cnpj=%s date=%s price=%s product=%s uf=%s", *[F.coalesce(c, F.lit("")) for c in ("cnpj_da_revenda", "data_da_coleta", "valor_de_venda", "produto", "estado_sigla")])
    if "raw_line" in cleaned.columns:  # a malformed line has no fields to tell of
        detail = F.when(F.col("reject_rule") == "field_count", F.col("raw_line")).otherwise(detail)
    keys = ["source_file_id", "reject_rule", "line_number"]
    lines = bad.select(*[F.col(k).alias(f"first_{k}") for k in keys]).distinct()
    rank = F.row_number().over(Window.partitionBy("first_source_file_id", "first_reject_rule").orderBy("first_line_number"))
    first = lines.withColumn("rank", rank).where(F.col("rank") <= samples)
    same = [F.col(k).eqNullSafe(F.col(f"first_{k}")) for k in keys]
    return bad.join(first, same, "left").select(
        "source_file_id", "line_number", F.col("reject_rule").alias("rule_name"), F.substring(detail, 1, 500).alias("detail"),
        F.when(F.col("rank").isNotNull(), F.to_json(F.struct(*SURVEY_COLUMNS))).alias("raw_row"), F.current_timestamp().alias("rejected_at"))
