"""Sketches that merge, profiles of files and reports."""

import datetime as dt

from pyspark.sql import functions as F
from test_warehouse import line, write

from tidemark.operators import sketches
from tidemark.plans.reports import SourceProfile, load_report, table, write_report
from tidemark.plans.warehouse import Warehouse
from tidemark.storage import get_text


def test_sketches_of_parts_are_those_of_the_whole(spark):
    rows = spark.range(0, 300_000, numPartitions=6).select((F.col("id") % 150_000).cast("string").alias("name"), F.when(F.col("id") % 10 == 3, F.lit("  ")).otherwise(F.concat(F.lit("v"), F.col("id") % 7)).alias("kind"), "id")
    parts = [rows.where(F.col("id") % 3 == k) for k in range(3)]
    columns = [sketches.sketch_columns(p, ["name", "kind"]) for p in parts]
    merged = {r.column: r for r in sketches.merge_columns(columns[0].unionByName(columns[1]).unionByName(columns[2])).collect()}
    assert (merged["name"].rows, merged["name"].missing, merged["name"].least, merged["name"].highest) == (300_000, 0, "0", "99999")
    assert abs(merged["name"].distinct_values - 150_000) < 150_000 * 4 * 1.04 / 2 ** (sketches.LG_K / 2)
    assert (merged["kind"].missing, merged["kind"].distinct_values) == (30_000, 7)
    numbers = [sketches.sketch_numbers(p, {"id": F.col("id"), "none": F.lit(None)}) for p in parts]
    got = {r.column: r for r in sketches.merge_numbers(numbers[0].unionByName(numbers[1]).unionByName(numbers[2])).collect()}
    assert set(got) == {"id"} and (got["id"].numbers, got["id"].mean, got["id"].low, got["id"].high) == (300_000, 149_999.5, 0.0, 299_999.0)
    assert all(abs(q / 300_000 - s) < 0.02 for q, s in zip(got["id"].quantiles, (0.1, 0.5, 0.9), strict=True))


def test_entities_over_parts(spark):
    seen = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "x", 1), ("b", "y", 2), ("c", "x", 1), ("c", "y", 1), ("", "z", 1), (None, "z", 2)], "k string, v string, file int")
    one = [sketches.summarise_entities(seen.where(F.col("file") == f), F.col("k"), {"v": F.col("v")}).withColumn("file", F.lit(f)) for f in (1, 2)]
    assert [tuple(r) for r in sketches.entity_changes(one[0].unionByName(one[1]), "file", 2, ["v"]).collect()] == [("v", 3, 2, 1)]


def test_profiles_of_files_and_their_report(spark, tmp_path):
    one = write(tmp_path, "one.csv", [line(day="02/01/2023"), line(cnpj="00003188000121", day="09/01/2023", brand="IPIRANGA", price=""), "too;short", line(cnpj="04431113000100", product="ETANOL", day="31/12/2023")])
    two = write(tmp_path, "two.csv", [line(day="03/07/2023", brand="SABBÁ", station="Posto Z"), line(day="03/07/2023", brand='"SABB;Á"')], "latin-1")
    profile = SourceProfile(spark, f"file://{tmp_path}/profile")
    for _ in range(2):  # a file that is added again takes its own place
        profile.add(1, one)
    profile.add(2, two)
    files = {r.file: r for r in profile.files().collect()}
    assert (files[1].encoding, files[2].encoding, files[1].rows, files[1].masked, files[2].rows, files[2].masked) == ("utf-8-sig", "latin-1", 3, 1, 2, 2)
    assert (files[1].first_day, files[1].last_day, files[2].name, len(files[2].columns)) == ("2023-01-02", "2023-12-31", "two.csv", 16) and files[1].bytes == (tmp_path / "one.csv").stat().st_size
    columns = {r.column: r for r in profile.columns().collect()}
    assert (columns["valor_de_venda"].missing, columns["cnpj_da_revenda"].distinct_values, columns["produto"].rows, columns["bandeira"].highest) == (1, 3, 5, "VIBRA")
    assert {(r.value, r.rows) for r in profile.values().where("column = 'produto'").collect()} == {("GASOLINA", 4), ("ETANOL", 1)}
    assert {tuple(r) for r in profile.changes().collect()} == {("brand", 2, 1, 1), ("name", 2, 1, 1), ("address", 2, 1, 0)}
    room = profile.storage(products=["ETANOL"]).first()
    assert room.rows_a_year == round(365.25 / ((dt.date(2023, 12, 31) - dt.date(2023, 1, 2)).days + 1)) and room.rows == round(3.5 * room.rows_a_year)
    text = profile.report()
    assert text.startswith("# Profile of the source") and "| produto | GASOLINA | 4 |" in text and "| brand | 2 | 1 | 1 |" in text
    for said in ("first", text):
        write_report(spark, f"file://{tmp_path}/profile.md", said)
    assert get_text(spark, f"file://{tmp_path}/profile.md") == text


def test_load_report(spark, tmp_path):
    house = Warehouse(spark, f"file://{tmp_path}/w")
    house.load(1, write(tmp_path, "1.csv", [line(), line(), line(day="16/03/2023", brand="novo"), line(uf="S1")]))
    house.refresh()
    text = load_report(house)
    assert "| 2023-01 | 4 | 1 | 2 | 1 |" in text and "| uf_invalid | 1 |" in text and "| brands to review | 1 |" in text and "| troca de distribuidora | 1 |" in text and "| 2023 | 2 | 1 |" in text
    assert "| 3 |" in table(spark.range(5).select(F.lit("a|b").alias("x"), "id"), most=4) and "a\\|b" in table(spark.range(1).select(F.lit("a|b").alias("x"))) and "the rest is left out" in table(spark.range(5), most=4)


def test_different_values_of_files_are_counted_exactly(spark, tmp_path):
    """Twelve thousand stations a file, half of them in both: more than a sketch tells one by one."""
    profile = SourceProfile(spark, f"file://{tmp_path}/profile")
    for file, first in ((1, 0), (2, 6_000)):
        profile.add(file, write(tmp_path, f"{file}.csv", [line(cnpj=f"{n:014d}", price=f"{n % 9_000 / 1000:.3f}".replace(".", ",")) for n in range(first, first + 12_000)]))
    found = {r.column: (r.rows, r.missing, r.distinct_values, r.least, r.highest) for r in profile.columns().collect()}
    assert found["cnpj_da_revenda"] == (24_000, 0, 18_000, "0" * 14, f"{17_999:014d}") and found["valor_de_venda"][2] == 9_000
    assert found["valor_de_compra"] == (24_000, 24_000, 0, None, None) and found["bandeira"][2] == 1
