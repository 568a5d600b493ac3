"""Reference data. Seeds are immutable: nothing that a load finds or misses deletes one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import ALIAS, BRAND, CATALOG, PRODUCT, SURVEY_COLUMNS

# Products by the survey's own text.
PRODUCTS = (
    (1, "GASOLINA", "Gasolina comum", "Gasolina", "R$/litro", True, True),
    (2, "GASOLINA ADITIVADA", "Gasolina aditivada", "Gasolina", "R$/litro", True, True),
    (3, "ETANOL", "Etanol hidratado", "Etanol", "R$/litro", True, True),
    (4, "DIESEL", "Óleo diesel", "Diesel", "R$/litro", True, True),
    (5, "DIESEL S10", "Óleo diesel S-10", "Diesel", "R$/litro", True, True),
    (6, "GNV", "Gás natural veicular", "GNV", "R$/m³", False, True),
)
# Canonical brands, and the two that were renamed.
UNBRANDED = "BRANCA"
BRANDS = (
    "BRANCA", "VIBRA", "IPIRANGA", "RAIZEN", "ALE", "SABBÁ", "ATEM'S", "RAIZEN MIME", "RODOIL", "STANG", "TAURUS", "CHARRUA", "DISLUB",
    "SP", "EQUADOR", "MAXSUL", "NEXTA", "TOTALENERGIES", "SIM DISTRIBUIDOR", "SANTA LUCIA", "SUL COMBUSTÍVEIS", "TEMAPE",
)
RENAMED = {"VIBRA ENERGIA": "VIBRA", "ALESAT": "ALE"}
NO_BRAND = "NÃO INFORMADA"
HALF_YEARS = ("2023-01", "2023-02", "2024-01", "2024-02", "2025-01", "2025-02", "2026-01")


def products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRODUCTS, PRODUCT)


def brands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, name == UNBRANDED, False, None) for i, name in enumerate(BRANDS, 1)], BRAND)


def aliases(spark: SparkSession) -> DataFrame:
    """Each brand's own name, and old names of renamed ones: a rename is no change of brand."""
    key = {name: i for i, name in enumerate(BRANDS, 1)}
    own = [(name, k, False, None) for name, k in key.items()]
    return spark.createDataFrame(own + [(old, key[new], True, f"now {new}") for old, new in RENAMED.items()], ALIAS)


def catalog(spark: SparkSession) -> DataFrame:
    """The half-yearly files, in the order in which they are loaded."""
    rows = []
    for i, label in enumerate(HALF_YEARS, 1):
        year, half = int(label[:4]), int(label[5:])
        rows.append((i, label, f"ca-{label}.csv", f"{year}-{'01-01' if half == 1 else '07-01'}", f"{year}-{'06-30' if half == 1 else '12-31'}", "utf-8-sig", ";", list(SURVEY_COLUMNS), None, "pending"))
    plain = spark.createDataFrame(rows, "source_file_id int, half_year string, file_name string, period_start string, period_end string, encoding string, delimiter string, expected_columns array<string>, sha256 string, status string")
    return plain.withColumns({c: F.col(c).cast("date") for c in ("period_start", "period_end")}).to(T.StructType.fromDDL(CATALOG))
