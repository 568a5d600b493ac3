"""Constants and schemas of the price survey model. Schemas are declared, as DDL, and never inferred."""

from __future__ import annotations

#: Stands for "still in force": a plain comparison date < valid_to works with it.
FOREVER = "9999-12-31"
EVENT_WINDOW_DAYS = 56
MIN_OBSERVATIONS = 4
MIN_STATIONS = 10
PARITY_LIMIT = 0.70
STUCK_MINUTES = 30
REJECT_SAMPLES = 100
MAX_PRICE = 50
CALENDAR = ("2023-01-01", "2027-12-31")
FACT_QUARTERS = (2023, 2026)

# The survey file's columns, in their order.
SURVEY_COLUMNS = (
    "regiao_sigla", "estado_sigla", "municipio", "revenda", "cnpj_da_revenda", "nome_da_rua", "numero_rua", "complemento",
    "bairro", "cep", "produto", "data_da_coleta", "valor_de_venda", "valor_de_compra", "unidade_de_medida", "bandeira",
)

STATION_ATTRIBUTES = ("legal_name", "brand_key", "city_key", "street", "street_number", "district", "zip_code")

REJECT = "source_file_id int, line_number int, rule_name string, detail string, raw_row string, rejected_at timestamp"
STATION = (
    "station_key long, cnpj string, legal_name string, brand_key int, city_key int, street string, street_number string, district string, "
    "zip_code string, complement string, valid_from date, valid_to date, is_current boolean, first_seen_file int, last_seen_file int, attribute_hash string"
)
FACT = "collection_date date, cnpj string, station_key long, product_key smallint, sale_price decimal(8,3), source_file_id int, quarter string"
SNAPSHOT = (
    "cnpj string, collection_date date, legal_name string, brand_key int, city_key int, street string, street_number string, district string, "
    "zip_code string, complement string, source_file_id int"
)
WEEKLY = (
    "survey_week_key int, week_start_date date, iso_year int, month_start_date date, city_key int, product_key smallint, observations long, stations long, "
    "p10_price decimal(8,3), median_price decimal(8,3), p90_price decimal(8,3), min_price decimal(8,3), max_price decimal(8,3), avg_price decimal(8,3)"
)
CITY = "city_key int, city_name string, uf string, region string, ibge_code string"
BRAND = "brand_key int, brand_name string, is_unbranded boolean, needs_review boolean, reviewed_at timestamp"
ALIAS = "alias_text string, brand_key int, is_rename boolean, note string"
MERGE = "brand_key int, into_key int, merged_at timestamp"
PRODUCT = "product_key smallint, source_product_name string, product_name string, fuel_family string, unit_of_measure string, is_liquid_fuel boolean, in_default_scope boolean"
CATALOG = (
    "source_file_id int, half_year string, file_name string, period_start date, period_end date, encoding string, delimiter string, "
    "expected_columns array<string>, sha256 string, status string"
)
RUN = (
    "run_id long, source_file_id int, stage string, status string, started_at timestamp, finished_at timestamp, rows_in long, rows_out long, rows_rejected long, message string"
)
