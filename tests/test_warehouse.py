"""Files, warehouse and boundaries of the survey model, on small fixtures."""

import csv
import datetime as dt
import hashlib
import itertools

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tidemark.functions.dates import week_key, week_month
from tidemark.functions.prices import price_percentile
from tidemark.operators import checks
from tidemark.operators.event_study import before_after, event_observations
from tidemark.operators.facts import build_stations, lowest_price, station_snapshots
from tidemark.operators.history import one_per
from tidemark.operators.keys import closure
from tidemark.plans import analog, loading, ops, questions, views, warehouse
from tidemark.plans.model import Model
from tidemark.plans.warehouse import Warehouse, load_order
from tidemark.schemas import BRAND, RUN
from tidemark.sources import seeds, survey_files
from tidemark.sources.byte_ranges import beginnings, byte_ranges, checksums
from tidemark.sources.survey_files import best_column, check_header, numbered_lines, numbered_records, read_survey, read_tolerant, sniff
from tidemark.storage import Conflict, Ledger, RuleBroken, Tables, children, derived_dir

HEADER = ";".join(loading.HEADER)


def line(station="Posto A", cnpj="00.003.188/0001-21", product="GASOLINA", day="15/03/2023", price="5,29", brand="VIBRA", cep="01310-100", complement="", uf="SP"):
    return f"SE;{uf};SAO PAULO;{station};{cnpj};RUA A;10;{complement};CENTRO;{cep};{product};{day};{price};;R$ / litro;{brand}"


def write(folder, name, lines, encoding="utf-8-sig", header=HEADER):
    path = folder / name
    path.write_bytes("\n".join([header, *lines, ""]).encode(encoding))
    return str(path)


def test_a_file_is_read_line_by_line(spark, tmp_path):
    rows = [line(), '"SE";SP;SAO PAULO;"Posto; B";04431113000100;R;1;;C;;ETANOL;16/03/2023;4,1;;l;"ALE"', ";" * 15, "", "SE;SP;only;four", line(price="")]
    got = {r.line_number: r for r in read_survey(spark, write(tmp_path, "a.csv", rows), 3).collect()}
    assert sorted(got) == [2, 3, 4, 5, 6, 7] and {r.source_file_id for r in got.values()} == {3}
    assert got[3].revenda == "Posto; B" and got[3].cep is None and got[3].bandeira == "ALE" and got[2].regiao_sigla == "SE"
    assert [got[k].is_malformed for k in sorted(got)] == [False, False, False, True, True, False]
    assert got[6].raw_line == "SE;SP;only;four" and got[6].municipio is None and got[7].valor_de_venda is None
    latin = write(tmp_path, "l.csv", [line(brand="SABBÁ")], "latin-1")
    assert read_survey(spark, latin, 1, "latin-1").first().bandeira == "SABBÁ"


def test_numbers_don_t_depend_on_splits(spark, tmp_path):
    path = write(tmp_path, "a.csv", [f"{i};{'x' * (i % 50)}" for i in range(3000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "7k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = {r.line_number: r.line for r in numbered_lines(spark, path, "utf-8-sig").collect()}
            assert len(lines) == 3001 and lines[1] == HEADER and all(lines[i + 2].startswith(f"{i};") for i in range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


QUOTED = [
    'a;"one\nfield";c', "plain;x;y", 'b;"two ""quoted""\n;still; inside\n";c', '"";"";""', 'stray;5" pipe;"x"', "", '"whole\n\nrecord";;', 'c;"tail"after;"z"', '"open;""\n";b;c', ";;", '"a""";"b\n""c""\nd";""""',
]


@pytest.mark.parametrize("size", ["128m", "64b", "7b"])
def test_records_with_line_breaks_at_any_split(spark, tmp_path, size):
    """The same rows as Python's reader of such files, wherever a split falls."""
    rows = [QUOTED[i * 7 % len(QUOTED)] for i in range(60 if size == "7b" else 400)]
    path = tmp_path / "q.csv"
    path.write_text("\n".join(["h1;h2;h3", *rows, ""]), encoding="utf-8")
    with open(path, encoding="utf-8", newline="") as f:
        want = list(csv.reader(f, delimiter=";"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        records = {r.record_number: (r.record, r.lines) for r in numbered_records(spark, str(path)).collect()}
        got = {r.line_number: r for r in read_survey(spark, str(path), 1, expected=["h1", "h2", "h3"]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(records) == len(want) and [records[i + 2][0] for i in range(len(rows))] == rows and records[2][1] == 2
    assert sorted(got) == list(range(2, len(want) + 1))
    for number, fields in enumerate(want[1:], 2):
        assert got[number].is_malformed == (len(fields) != 3), (number, fields)
        if len(fields) == 3 and "tail" not in fields[1]:  # letters after a closing quote: kept by either reader in its own way
            assert [got[number][c] or "" for c in ("h1", "h2", "h3")] == fields


def test_a_quote_that_never_closes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(survey_files, "MOST_LINES", 50)
    path = write(tmp_path, "a.csv", [line(), '"never', *[line()] * 100])
    with pytest.raises(Exception, match="a quote is not closed in record 3"):
        read_survey(spark, path, 1).collect()


def test_a_file_of_over_two_gigabytes(spark, tmp_path):
    path = tmp_path / "large.bin"
    with open(path, "wb") as f:
        f.truncate((2 << 30) + 4097)
    row = checksums(spark, str(path)).first()
    digest, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(2 << 10):
        digest.update(block)
    digest.update(bytes(4097))
    assert (row.bytes, row.sha256) == ((2 << 30) + 4097, digest.hexdigest()) and sniff(spark, str(path))[0] == "utf-8"


def test_headers_must_agree(spark, tmp_path):
    with pytest.raises(ValueError, match=r"lacking \['bandeira'\], unexpected \['marca'\]"):
        read_survey(spark, write(tmp_path, "a.csv", [line()], header=HEADER.replace("Bandeira", "Marca")), 1)
    swapped = ";".join(["Estado - Sigla", "Região - Sigla", *loading.HEADER[2:]])
    with pytest.raises(ValueError, match="another order"):
        read_survey(spark, write(tmp_path, "b.csv", [line()], header=swapped), 1)
    check_header(["a"], ["a"], "x")


def test_what_a_file_looks_like(spark, tmp_path):
    a, b = write(tmp_path, "a.csv", [line()]), write(tmp_path, "b.csv", [line(brand="SABBÁ").replace(";", "\t")], "latin-1", HEADER.replace(";", "\t"))
    assert sniff(spark, a) == ("utf-8-sig", ";") and sniff(spark, b) == ("latin-1", "\t")
    with open(a, "rb") as f:
        assert checksums(spark, a).first().sha256 == hashlib.sha256(f.read()).hexdigest()
    assert best_column(["cnpj_da_revenda", "revenda"], "revenda") == "revenda" and best_column(["cnpj_da_revenda", "revenda"], "cnpj") == "cnpj_da_revenda" and best_column(["a"], "b") is None
    cut = write(tmp_path, "d.csv", ["a;b;c,d,e,f,g", "é" * 50, *["a;b;c,"] * 9], "utf-8", "x;y;z")
    assert sniff(spark, cut, 29) == ("utf-8", ";") and beginnings(spark, cut, 29).first().content == open(cut, "rb").read()[:29]
    assert b"".join(bytes(r.content) for r in byte_ranges(spark, cut, 50).orderBy("start").collect()) == open(cut, "rb").read()
    assert read_tolerant(spark, write(tmp_path, "c.csv", [line(), "a;b", line()], "utf-8")).count() == 2


@pytest.fixture
def house(spark, tmp_path):
    return Warehouse(spark, f"file://{tmp_path}/warehouse")


def test_load_of_two_files_in_any_order_and_twice(spark, tmp_path, house):
    one = write(tmp_path, "1.csv", [line(day="02/01/2023"), line(day="09/01/2023", price="5,46"), line(day="09/01/2023", price="5,29"), line(day="10/01/2023", brand="BRANCA"), line(uf="S1"), "short;line", line(day="15/03/2019")])
    two = write(tmp_path, "2.csv", [line(day="03/07/2023"), line(day="04/07/2023", product="ETANOL", price="3,5", brand="novo"), line(day="04/07/2023", product="??")])
    tables = []
    for n, order in enumerate(([(1, one), (2, two)], [(2, two), (1, one)], [(1, one), (2, two), (1, one), (2, two)])):
        h = Warehouse(spark, f"file://{tmp_path}/w{n}")
        for file, path in order:
            h.load(file, path)
        h.refresh()
        facts = h.facts().join(h.stations().select("station_key", "valid_from"), "station_key").select("cnpj", "product_key", "collection_date", "sale_price", "source_file_id", "quarter", "valid_from")
        spans = h.stations().join(h.tables.read("brands", BRAND), "brand_key").select("cnpj", "brand_name", "valid_from", "valid_to", "first_seen_file", "last_seen_file")
        tables.append([sorted(map(str, df.collect())) for df in (facts, spans, h.weekly().drop("city_key"), h.tables.read("rejects", "source_file_id int, rule_name string").select("source_file_id", "rule_name"))])
        assert {(r.source_file_id, r.status) for r in h.catalog().collect()} == {(1, "loaded"), (2, "loaded"), *((k, "pending") for k in range(3, 8))}
        assert [r.source_file_id for r in load_order(h.catalog()).orderBy("turn").collect()] == [3, 4, 5, 6, 7]
    assert tables[0] == tables[1] == tables[2]
    assert len(tables[0][0]) == 5 and "Decimal('5.290')" in "".join(tables[0][0]) and "Decimal('5.460')" not in "".join(tables[0][0])
    assert len(tables[0][1]) == 4 and [t for t in tables[0][3] if "field_count" in t] and len(tables[0][3]) == 4
    runs = [r.asDict() for r in h.runs().where("stage = 'facts'").orderBy("run_id").collect()]
    assert [r["rows_out"] for r in runs] == [3, 2, 0, 0] and {r["status"] for r in runs} == {"done"}
    sizes = h.table_sizes().collect()
    assert {(r.table, r.quarter) for r in sizes} >= {("facts", "2023q1"), ("facts", "2023q3"), ("stations", None)} and all(r.bytes > 0 for r in sizes)


def test_a_load_that_fails_is_in_the_ledger(spark, tmp_path, house):
    bad = write(tmp_path, "1.csv", [line()], header="a;b")
    with pytest.raises(ValueError, match="header differs"):
        house.load(1, bad)
    run = house.runs().first()
    assert (run.stage, run.status, house.catalog().where("source_file_id = 1").first().status) == ("read", "failed", "failed") and "header differs" in run.message
    with pytest.raises(ValueError, match="no file 99"):
        house.load(99, bad)
    house.load(1, write(tmp_path, "1.csv", [line()]))
    assert house.catalog().where("source_file_id = 1").first().status == "loaded" and house.facts().count() == 1
    house.refresh()
    m = house.model()
    m.register()
    assert spark.sql("SELECT count(*) n FROM survey_facts JOIN survey_stations USING (station_key)").first().n == 1


def state_of(h):
    """What a warehouse has, by names instead of keys."""
    brands = h.tables.read("brands", BRAND).select("brand_key", "brand_name")
    facts = h.facts().join(h.stations().select("station_key", "valid_from", "brand_key"), "station_key").join(brands, "brand_key").select("cnpj", "product_key", "collection_date", "sale_price", "source_file_id", "valid_from", "brand_name")
    spans = h.stations().join(brands, "brand_key").select("cnpj", "legal_name", "brand_name", "valid_from", "valid_to", "is_current", "first_seen_file", "last_seen_file")
    return [sorted(map(str, df.collect())) for df in (facts, spans, h.rejects().select("source_file_id", "line_number", "rule_name"), h.weekly().drop("city_key"))]


def test_a_corrected_file_leaves_nothing_of_the_first(spark, tmp_path):
    first = [line(day="02/01/2023"), line(day="09/01/2023", price="5,46"), line(day="09/01/2023", cnpj="04431113000100", station="B"), line(product="??")]
    second = [line(day="02/01/2023", price="5,10"), line(day="09/01/2023", price="5,46", brand="IPIRANGA"), line(day="10/01/2023", price="5,5", brand="IPIRANGA")]
    later = [line(day="03/07/2023", brand="VIBRA"), line(day="04/07/2023", product="???")]
    one, two, other = write(tmp_path, "1.csv", first), write(tmp_path, "1b.csv", second), write(tmp_path, "2.csv", later)
    corrected, alone, kept = (Warehouse(spark, f"file://{tmp_path}/{n}") for n in ("a", "b", "c"))
    corrected.load(1, one)
    corrected.load(2, other)
    corrected.refresh()
    in_force = lambda: [str(r.valid_from) for r in corrected.facts().where("collection_date > '2023-07-01'").join(corrected.stations(), "station_key").collect()]
    assert in_force() == ["2023-01-02"]
    corrected.load(1, two, replace_prices=True)
    corrected.refresh()
    alone.load(1, two)
    alone.load(2, other)
    alone.refresh()
    assert state_of(corrected) == state_of(alone)
    assert not corrected.rejects().where("source_file_id = 1").count() and corrected.rejects().where("source_file_id = 2").count() == 1
    assert corrected.facts().where("cnpj = '04431113000100'").count() == 0 and corrected.stations().where("cnpj = '04431113000100'").count() == 0
    assert in_force() == ["2023-07-03"]  # the other file's fact points to the version that the correction has made
    corrected.verify()
    # Without replace_prices a stored price stays, and what differs is told.
    kept.load(1, one)
    kept.load(1, two)
    assert {(str(r.collection_date), str(r.sale_price)) for r in kept.facts().where("cnpj = '00003188000121'").collect()} == {("2023-01-02", "5.290"), ("2023-01-09", "5.460"), ("2023-01-10", "5.500")}
    runs = [r for r in kept.runs().where("stage = 'facts'").orderBy("run_id").collect()]
    assert runs[1].message == "prices that differ from stored ones: 1; facts restated: 1; facts without a version: 1" and runs[1].rows_out == 1
    kept.verify()


def test_a_load_that_is_killed_changes_nothing(spark, tmp_path, house, monkeypatch):
    one, two = write(tmp_path, "1.csv", [line(), line(day="16/03/2023")]), write(tmp_path, "2.csv", [line(day="03/07/2023", brand="novo"), line(uf="S1")])
    house.load(1, one)
    house.refresh()
    before, parts = state_of(house), house.tables.snapshot().content

    class Killed(BaseException):
        pass

    for at in ("_put_snapshots", "_build_versions", "_restate", "add_facts"):
        def killed(*a, own=getattr(Warehouse, at), **k):
            own(*a, **k)
            raise Killed

        with monkeypatch.context() as m, pytest.raises(Killed):
            m.setattr(Warehouse, at, killed)
            m.setattr("tidemark.storage.Transaction.discard", lambda self: None)  # nothing is tidied up by what is dead
            house.load(2, two)
        assert house.tables.snapshot().content == parts
    assert state_of(house) == before and house.runs().where("status = 'failed'").count() == 4
    assert house.tables.vacuum() > 0 and state_of(house) == before
    house.load(2, two)
    assert house.facts().count() == 3 and house.tables.vacuum() == 0


def test_of_two_writers_one_gets_through(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    with t.transaction() as a:
        a.replace("x", spark.range(3))
    seen = t.snapshot()
    with pytest.raises(Conflict), t.transaction() as late:
        late.append("x", spark.range(5))
        with t.transaction() as first:
            first.replace("x", spark.range(10, 12))
            assert first.read("x", "id long").count() == 2 and t.read("x", "id long").count() == 3
    assert t.read("x", "id long").count() == 2 and seen.read("x", "id long").count() == 3
    with pytest.raises(RuleBroken, match="x: small"), t.transaction() as c:
        c.append("x", spark.range(50), rules={"small": "id < 40"})
    assert t.read("x", "id long").count() == 2 and len(children(spark, f"file://{tmp_path}/t/x")) == 2


def test_rules_stop_a_load(spark, tmp_path, house, monkeypatch):
    monkeypatch.setitem(warehouse.FACT_RULES, "cheap", "sale_price < 5")
    with pytest.raises(RuleBroken, match="facts: cheap"):
        house.load(1, write(tmp_path, "1.csv", [line(), line(price="4,9", day="16/03/2023")]))
    assert not house.tables.has("facts") and house.runs().where("stage = 'facts'").first().status == "failed" and house.catalog().where("source_file_id = 1").first().status == "failed"


def test_other_code_reads_no_old_tables(spark, tmp_path, monkeypatch):
    source = tmp_path / "input.txt"
    source.write_text("x")
    one = derived_dir(spark, "probe", f"file://{source}")
    with Tables(spark, one).transaction() as t:
        t.replace("x", spark.range(1))
    assert derived_dir(spark, "probe", f"file://{source}") == one and Tables(spark, one).has("x")
    monkeypatch.setattr("tidemark.storage.code_state", lambda: "other")
    assert derived_dir(spark, "probe", f"file://{source}") != one and not Tables(spark, one).has("x")


def test_a_small_load_writes_little(spark, tmp_path):
    many = [line(cnpj=f"{i:014d}", day=f"{d:02d}/{m:02d}/2023") for i in range(1, 60) for m in (1, 4) for d in (2, 9)]
    h = Warehouse(spark, f"file://{tmp_path}/w")
    h.load(1, write(tmp_path, "1.csv", many))
    h.refresh()
    before = h.tables.snapshot()
    h.load(2, write(tmp_path, "2.csv", [line(cnpj=f"{7:014d}", day="03/07/2023", brand="novo")]))
    h.refresh()
    after = h.tables.snapshot()
    changed = {n: [p for p, f in after.parts(n).items() if before.parts(n).get(p) != f] for n in ("stations", "facts", "weekly", "snapshots")}
    assert [len(changed[n]) for n in ("stations", "facts", "weekly", "snapshots")] == [1, 1, 1, 1] and changed["weekly"] == ["quarter=2023q3"]
    assert h.stations().where("cnpj = '00000000000007'").count() == 2 and h.stations().count() == 60
    own, late = h.facts_of(f"{7:014d}"), h.facts_of(f"{7:014d}", f"{8:014d}", since="2023-05-01")
    assert own.count() == 5 and len(own.inputFiles()) == 3 < len(h.facts().inputFiles()) and late.count() == 1 and all("2023q" in f and "2023q1" not in f for f in late.inputFiles())
    rolled = sorted(map(str, h.weekly().collect()))
    h.refresh(whole=True)
    assert rolled == sorted(map(str, h.weekly().collect()))


def test_merges_outlive_loads(spark, tmp_path, house):
    house.load(1, write(tmp_path, "1.csv", [line(day="02/01/2023", brand="OLD A"), line(day="09/01/2023", brand="OLD B"), line(day="16/01/2023", brand="NEW C"), line(day="16/01/2023", cnpj="04431113000100", brand="OLD A")]))
    house.refresh()
    assert house.stations().count() == 4 and house.model().brand_changes.count() == 2
    house.merge_brand("OLD A", "OLD B")
    house.merge_brand("OLD B", "NEW C")
    house.review_brands("NEW C")

    def holds():
        names = {r.brand_name for r in house.stations().join(house.tables.read("brands", BRAND), "brand_key").collect()}
        assert names <= {"NEW C", "VIBRA"} and house.facts().join(house.stations(), "station_key").count() == house.facts().count()
        house.verify()

    holds()
    assert house.stations().count() == 2 and house.model().brand_changes.count() == 0
    house.load(2, write(tmp_path, "2.csv", [line(day="03/07/2023", brand="old a"), line(day="04/07/2023", brand="VIBRA")]))
    holds()
    spans = house.stations().where("cnpj = '00003188000121'").orderBy("valid_from").collect()
    assert len(spans) == 2 and house.model().brand_changes.count() == 1 and str(spans[1].valid_from) == "2023-07-04"
    assert [r.stage for r in house.runs().where("stage in ('merge_brand', 'review')").orderBy("run_id").collect()] == ["merge_brand", "merge_brand", "review"]
    assert house.tables.read("brands", BRAND).where("brand_name = 'NEW C' and not needs_review and reviewed_at is not null").count() == 1


def test_pending_files_are_loaded_in_order(spark, tmp_path, house):
    for name, day in (("ca-2023-02.csv", "03/07/2023"), ("ca-2023-01.csv", "02/01/2023")):
        write(tmp_path, name, [line(day=day)])
    assert house.load_pending(f"file://{tmp_path}") == [1, 2] and house.load_pending(f"file://{tmp_path}") == []
    house.load(1, f"file://{tmp_path}/ca-2023-01.csv", keep_staging=True)
    assert house.tables.has("staging") and house.facts().count() == 2


def test_chains_of_merges(spark):
    found = closure(spark.createDataFrame([(k, k + 1) for k in range(1, 9)] + [(20, 21)], "brand_key int, into_key int"))
    assert {(r.brand_key, r.into_key) for r in found.collect()} == {*((k, 9) for k in range(1, 9)), (20, 21)}


def test_ledger_notes_are_gathered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.storage.Ledger.GATHER", 6)
    ledger = Ledger(spark, f"file://{tmp_path}/runs")
    for i in range(5):
        ledger.end(ledger.begin({"stage": f"s{i}", "status": "running"}) | {"status": "done"})
    rows = ledger.read("run_id long, stage string, status string").where("status = 'done'").collect()
    assert sorted((r.run_id, r.stage) for r in rows) == [(i + 1, f"s{i}") for i in range(5)] and len(children(spark, f"file://{tmp_path}/runs")) == 5


DAY = dt.date(2023, 5, 1)


def snapshots(spark, states, file=1):
    """One station: (day offset, brand, zip, complement, line)."""
    rows = [("1" * 14, DAY + dt.timedelta(d), "POSTO", b, 1, "R", "1", None, z, c, file, n) for d, b, z, c, n in states]
    return spark.createDataFrame(rows, "cnpj string, collection_date date, legal_name string, brand_key int, city_key int, street string, street_number string, district string, zip_code string, complement string, source_file_id int, line_number int")


@pytest.mark.parametrize(("states", "want"), [
    ([(0, 1, "z", None, 1), (7, 1, "z", None, 2)], [(0, None, 1)]),
    ([(0, 1, "z", None, 1), (7, 2, "z", None, 2)], [(0, 7, 1), (7, None, 2)]),
    ([(0, 1, "z", None, 1), (7, 2, "z", None, 2), (14, 1, "z", None, 3)], [(0, 7, 1), (7, 14, 2), (14, None, 1)]),
    ([(0, 1, None, None, 1), (7, 1, "z", None, 2), (9, 1, None, None, 3)], [(0, 7, 1), (7, 9, 1), (9, None, 1)]),
    ([(0, 1, "z", "b", 1), (7, 1, "z", "a", 2)], [(0, None, 1)]),
    ([(0, 2, "z", None, 9), (0, 1, "z", None, 4), (7, 1, "z", None, 12)], [(0, None, 1)]),
])
def test_station_versions(spark, states, want):
    built = build_stations(station_snapshots(snapshots(spark, states))).orderBy("valid_from").collect()
    days = lambda d: None if d == dt.date(9999, 12, 31) else (d - DAY).days
    assert [(days(r.valid_from), days(r.valid_to), r.brand_key) for r in built] == want
    assert all(r.is_current == (days(r.valid_to) is None) for r in built)
    assert {r.complement for r in built} <= {None, "a"}


def test_versions_over_files_in_any_order(spark):
    one, two = snapshots(spark, [(0, 1, "z", None, 1), (7, 2, "z", None, 2)], 1), snapshots(spark, [(7, 1, "z", None, 1), (14, 1, "z", None, 2)], 2)
    seen = set()
    for files in itertools.permutations([one, two, two]):
        each = [station_snapshots(f) for f in files]
        every = one_per(each[0].unionByName(each[1]).unionByName(each[2]), ["cnpj", "collection_date"], ["source_file_id"])
        seen.add(str(sorted((r.valid_from, r.valid_to, r.brand_key, r.first_seen_file, r.last_seen_file, r.station_key) for r in build_stations(every).collect())))
    assert len(seen) == 1


def test_lowest_of_repeated_prices(spark):
    rows = spark.createDataFrame([("a", 1, DAY, 5.46, 1), ("a", 1, DAY, 5.29, 2), ("b", 1, DAY, 5.0, 2), ("b", 1, DAY, 5.0, 1)], "cnpj string, product_key int, collection_date date, sale_price double, source_file_id int")
    assert {(r.cnpj, r.sale_price, r.source_file_id) for r in lowest_price(rows).collect()} == {("a", 5.29, 2), ("b", 5.0, 1)}


def test_weeks_and_middles(spark):
    days = spark.createDataFrame([(dt.date(2024, 12, 30),), (dt.date(2024, 5, 1),)], "d date").select(week_key(F.col("d")).alias("k"), week_month(F.col("d")).alias("m")).collect()
    assert days[0].k == 202501 and days[0].m == dt.date(2024, 12, 1) and days[1].m == dt.date(2024, 4, 1)
    middle = spark.createDataFrame([(5.100,), (5.201,)], "p double").agg(price_percentile("p", 0.5).alias("m")).first().m
    assert str(middle) == "5.151"


def test_event_window_edges(spark):
    event = dt.date(2024, 6, 6)
    at = [-57, -56, -1, 0, 55, 56]
    facts = spark.createDataFrame([(1 if d < 0 else 2, event + dt.timedelta(d), 1, 5.0 + d / 1000) for d in at], "station_key int, collection_date date, product_key int, sale_price double")
    events = spark.createDataFrame([(1, 2, event)], "station_key_before int, station_key_after int, changed_on date")
    seen = event_observations(events, facts, ("station_key_before", "station_key_after"), "changed_on")
    assert {((r.collection_date - event).days, r.phase) for r in seen.collect()} == {(-56, "before"), (-1, "before"), (0, "after"), (55, "after")}
    assert before_after(seen, ["changed_on"], 2).count() == 1 and before_after(seen, ["changed_on"], 3).count() == 0


def small_model(spark, weekly):
    names = "survey_week_key int, week_start_date date, city_key int, product_key int, observations long, stations long, p10_price double, median_price double, p90_price double"
    cities = spark.createDataFrame([(1, "A", "SP", "SE"), (2, "B", "RJ", "SE")], "city_key int, city_name string, uf string, region string")
    products = spark.createDataFrame([(1, "g"), (3, "e")], "product_key int, product_name string")
    return Model(None, None, cities, products, None, None, spark.createDataFrame(weekly, names))


def test_parity_and_dispersion_floor(spark):
    w = dt.date(2024, 1, 1)
    m = small_model(spark, [(202401, w, 1, 1, 20, 10, 4.9, 5.0, 5.1), (202401, w, 1, 3, 20, 9, 3.4, 3.5, 3.6), (202401, w, 2, 1, 20, 10, 5.0, 5.0, 5.0)])
    parity = views.ethanol_parity(m).collect()
    assert [(r.city_name, r.parity_ratio, r.ethanol_wins, r.min_stations) for r in parity] == [("A", 0.7, False, 9)]
    assert {(r.city_name, r.stations) for r in views.price_dispersion(m).collect()} == {("A", 10), ("B", 10)}


def test_runs_that_are_stuck(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 12) - dt.timedelta(minutes=m)
    runs = spark.createDataFrame([(1, 1, "read", "running", at(31), None, 0, 0, 0, None), (2, 1, "read", "running", at(29), None, 0, 0, 0, None), (3, 1, "read", "done", at(90), at(60), 0, 0, 0, None), (4, 1, "x", "done", at(90), at(60), 200, 150, 50, None)], RUN)
    assert [(r.run_id, r.minutes) for r in ops.stuck_runs(runs, "2024-01-01 12:00:00").collect()] == [(1, 31)]
    assert {r.run_id: (r.pct_rejected, r.seconds) for r in ops.load_health(runs, seeds.catalog(spark)).where("run_id > 2").collect()} == {3: (None, 1800), 4: (25.0, 1800)}


def test_require_names_the_rule(spark):
    checks.require({"fine": spark.range(0)})
    with pytest.raises(ValueError, match="rule broken: odd"):
        checks.require({"fine": spark.range(0), "odd": spark.range(2)})


def test_questions_read_only_their_quarters(spark):
    m = analog.model(spark, f"{DATA}/sf0.001")
    plan = questions.weekly_series(m, since="2024-04-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((quarter" in plan.replace("isnotnull(quarter#", "(quarter#") or "2024q2" in plan.split("PartitionFilters")[1][:200]
    assert "PushedFilters: [IsNotNull(collection_date)" in plan or "GreaterThanOrEqual(collection_date" in plan
