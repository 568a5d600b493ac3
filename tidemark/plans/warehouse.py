"""The survey's warehouse: files in, tables out, each step in a ledger of runs.

A load is one transaction: what it has written becomes visible with its commit, or never. It replaces what its file gave before,
rejects and snapshots of stations, and finds the stations whose snapshots have changed thereby. Only their versions are built anew, in
the buckets where they live, and only facts of theirs whose version is another now are restated, in the partitions that hold
them. So files may come in any order, twice, or corrected, and a small file writes little, however long the history.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import quarter, week_start
from tidemark.operators import checks
from tidemark.operators.clean import accepted, clean, rejects
from tidemark.operators.facts import build_facts, build_stations, lowest_price, station_snapshots
from tidemark.operators.history import changed_keys, one_per
from tidemark.operators.keys import brand_keys, canonical, city_keys, merge_brand, new_brands, new_cities, review
from tidemark.operators.rollup import weekly_rollup
from tidemark.plans.model import Model
from tidemark.schemas import ALIAS, BRAND, CALENDAR, CATALOG, CITY, FACT, FOREVER, MERGE, REJECT, RUN, SNAPSHOT, STATION, STATION_ATTRIBUTES, WEEKLY
from tidemark.sources import seeds
from tidemark.sources.byte_ranges import digest_of
from tidemark.sources.survey_files import read_survey
from tidemark.storage import Conflict, Ledger, Snapshot, Tables, Transaction, exists

PENDING, LOADED, FAILED, RUNNING, DONE = "pending", "loaded", "failed", "running", "done"
#: Buckets of stations by a hash of their number: what a change of one station writes is a bucket.
BUCKETS = 16
_BUCKET = ", bucket int"

#: What each row that is written must hold, as SQL.
STATION_RULES = {
    "14 digits": "cnpj RLIKE '^[0-9]{14}$'",
    "versions are dated well": f"valid_from < valid_to AND is_current = (valid_to = DATE '{FOREVER}')",
    "versions have brands and cities": "brand_key IS NOT NULL AND city_key IS NOT NULL",
}
FACT_RULES = {
    "facts are plausible": f"sale_price > 0 AND collection_date BETWEEN DATE '{CALENDAR[0]}' AND DATE '{CALENDAR[1]}'",
    "facts have versions": "station_key IS NOT NULL",
}


@dataclass
class Step:
    """Row counts of a step, and a message, filled while it runs."""

    rows_in: int | None = None
    rows_out: int | None = None
    rows_rejected: int | None = None
    message: str | None = None


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat(timespec="microseconds")


class Warehouse:
    def __init__(self, spark: SparkSession, folder: str, products: DataFrame | None = None, buckets: int = BUCKETS, fact_rules: dict[str, str] = FACT_RULES) -> None:
        self.spark, self.tables, self.products, self.fact_rules = spark, Tables(spark, folder), products if products is not None else seeds.products(spark), fact_rules
        self.ledger = Ledger(spark, f"{folder.rstrip('/')}/_runs")
        now = self.tables.snapshot()
        if not now.has("catalog"):
            try:
                with self.tables.transaction() as t:
                    for name, seed in (("catalog", seeds.catalog), ("brands", seeds.brands), ("aliases", seeds.aliases)):
                        t.replace(name, seed(spark).coalesce(1))
                    t.marks["buckets"] = buckets
            except Conflict:
                pass  # another session has made the same
            now = self.tables.snapshot()
        self.buckets = now.marks["buckets"]

    # Control tables

    def catalog(self) -> DataFrame:
        return self.tables.read("catalog", CATALOG)

    def runs(self) -> DataFrame:
        """The last state of each run."""
        return one_per(self.ledger.read(RUN), ["run_id"], [F.col("finished_at").isNull()])

    @contextmanager
    def step(self, stage: str, source_file_id: int | None = None):
        """A run in the ledger: running, then done with its row counts, or failed with its message."""
        run = self.ledger.begin({"source_file_id": source_file_id, "stage": stage, "status": RUNNING, "started_at": _now()})
        counts, end = Step(), {"status": DONE}
        try:
            yield counts
        except BaseException as error:
            end = {"status": FAILED, "message": str(error)[:500]}
            raise
        finally:
            self.ledger.end(run | vars(counts) | end | {"finished_at": _now()})

    @staticmethod
    def _mark(t: Transaction, source_file_id: int, status: str, sha256: str | None = None) -> None:
        own = F.col("source_file_id") == source_file_id
        catalog = t.read("catalog", CATALOG).withColumns({"status": F.when(own, status).otherwise(F.col("status")), "sha256": F.when(own & F.lit(sha256 is not None), F.lit(sha256)).otherwise(F.col("sha256"))})
        t.replace("catalog", catalog.coalesce(1))

    # Loading

    def bucket(self, cnpj: str = "cnpj") -> Column:
        return F.pmod(F.xxhash64(cnpj), F.lit(self.buckets)).cast("int").alias("bucket")

    def load_pending(self, folder: str) -> list[int]:
        """Load the catalog's files that are not loaded yet and lie in a folder, in the order of their periods."""
        done = []
        for r in load_order(self.catalog()).orderBy("turn").collect():  # a row a file
            if exists(self.spark, path := f"{folder.rstrip('/')}/{r['file_name']}"):
                self.load(r["source_file_id"], path)
                done.append(r["source_file_id"])
        return done

    def load(self, source_file_id: int, path: str, replace_prices: bool = False, keep_staging: bool = False) -> None:
        """Load one file of the catalog, or load it again.

        A price that is stored stays, and what a corrected file has instead is counted in the message of the facts' run; with
        ``replace_prices`` the file's own prices are replaced by what it has now. A fact whose station no file names on its
        day any more, before or on it, goes. ``keep_staging`` keeps the cleaned rows as the table ``staging``."""
        entry = self.catalog().where(F.col("source_file_id") == source_file_id).first()
        if entry is None:
            raise ValueError(f"no file {source_file_id} in the catalog")
        try:
            with self.tables.transaction() as t:
                self._load(t, entry, path, replace_prices, keep_staging)
        except Exception:
            with self.tables.transaction() as t:
                self._mark(t, source_file_id, FAILED)
            raise

    def _load(self, t: Transaction, entry, path: str, replace_prices: bool, keep_staging: bool) -> None:
        file = entry["source_file_id"]
        with self.step("read", file) as step:
            digest = digest_of(self.spark, path)
            cleaned = clean(read_survey(self.spark, path, file, entry["encoding"], entry["delimiter"], entry["expected_columns"]), self.products)
            fit = F.col("reject_rule").isNull()
            got = t.replace("staging", cleaned, counts={"good": F.count_if(fit), "quarters": F.collect_set(F.when(fit, quarter(F.col("collection_date"))))})
            step.rows_in = step.rows_out = got["rows"]
        cleaned = t.read("staging", cleaned.schema)  # read and cleaned once: all further steps read it
        with self.step("validate", file) as step:
            t.put("rejects", rejects(cleaned), ("source_file_id",), _of_file(file))
            step.rows_in, step.rows_out, step.rows_rejected = got["rows"], got["good"], got["rows"] - got["good"]
        good = accepted(cleaned)
        with self.step("stations", file) as step:
            self._add_keys(t, good)
            changed = self._put_snapshots(t, file, good)
            step.rows_out = changed["rows"]
            self._build_versions(t, changed)
        with self.step("facts", file) as step:
            moved, gone = self._restate(t, changed)
            added, differing = self.add_facts(t, lowest_price(good), file, got["quarters"] or [], replace_prices)
            step.rows_in, step.rows_out = got["good"], added
            notes = {"prices that differ from stored ones": differing, "facts restated": moved, "facts without a version": gone}
            step.message = "; ".join(f"{k}: {n}" for k, n in notes.items() if n) or None
            self._mark(t, file, LOADED, digest)
            t.drop("changes", *([] if keep_staging else ["staging"]))
            t.commit()

    def _add_keys(self, t: Transaction, good: DataFrame) -> None:
        """Brands and cities that the rows name for the first time. Keys are read back: they are then the same for every table, however
        often a lost task is run again."""
        brands, aliases = new_brands(good, t.read("brands", BRAND), t.read("aliases", ALIAS))
        if t.append("brands", brands.coalesce(1))["rows"]:
            known = t.read("brands", BRAND).select(F.col("brand_name").alias("alias_text"), "brand_key")
            t.append("aliases", aliases.join(known, "alias_text").select(*_names(ALIAS)).coalesce(1))
        t.append("cities", new_cities(good, t.read("cities", CITY)).coalesce(1))

    def _put_snapshots(self, t: Transaction, file: int, good: DataFrame) -> dict:
        """Replace the file's snapshots; what ``_note_changes`` says of the stations that differ thereby."""
        stored = SNAPSHOT + _BUCKET
        old = t.read("snapshots", stored, _of_file(file))
        rows = city_keys(brand_keys(good, t.read("aliases", ALIAS)), t.read("cities", CITY))
        t.put("snapshots", station_snapshots(rows).select(*_names(SNAPSHOT), self.bucket()).repartition("bucket"), ("source_file_id", "bucket"), _of_file(file))
        new = t.read("snapshots", stored, _of_file(file))
        changed = changed_keys(self._canonical(t, old), self._canonical(t, new), ["cnpj", "bucket"], "collection_date", [*STATION_ATTRIBUTES, "complement"])
        return self._note_changes(t, changed)

    @staticmethod
    def _note_changes(t: Transaction, changed: DataFrame) -> dict:
        """Write stations with the first day from which they may have changed as the table ``changes``; their number, their buckets and the first quarter."""
        return t.replace("changes", changed, counts={"buckets": F.collect_set("bucket"), "first": F.min(quarter(F.col("first_day")))})

    def _canonical(self, s: Snapshot, rows: DataFrame) -> DataFrame:
        return canonical(rows, s.read("merges", MERGE)) if s.has("merges") else rows

    def _build_versions(self, t: Transaction, changed: dict) -> None:
        """Versions of the stations in ``changes``, from all their snapshots; other stations of their buckets are copied."""
        changes, touched = t.read("changes", _CHANGES), set(changed["buckets"] or [])
        if not touched:
            return
        here = lambda v: int(v["bucket"]) in touched
        own = self._canonical(t, t.read("snapshots", SNAPSHOT + _BUCKET, here)).join(changes.select("cnpj"), "cnpj", "left_semi")
        built = build_stations(one_per(own, ["cnpj", "collection_date"], ["source_file_id"])).withColumn("bucket", self.bucket())
        others = t.read("stations", STATION + _BUCKET, here).join(changes.select("cnpj"), "cnpj", "left_anti")
        t.put("stations", built.unionByName(others).repartition("bucket"), ("bucket",), here, STATION_RULES)

    def _restate(self, t: Transaction, changed: dict) -> tuple[int, int]:
        """Point facts of the stations in ``changes`` to the versions that are in force now, where these are others; (facts restated, facts that have none and go).

        Looked at are the quarters from the first changed day on, and only partitions with such a fact are written."""
        changes, touched, first = t.read("changes", _CHANGES), set(changed["buckets"] or []), changed["first"]
        if not touched or not t.has("facts"):
            return 0, 0
        here = lambda v: int(v["bucket"]) in touched
        facts = t.read("facts", _FACTS, lambda v: here(v) and (v["quarter"] >= first or first == "default"))
        stations = t.read("stations", STATION + _BUCKET, here)
        asked = facts.join(changes.select("cnpj", "first_day"), "cnpj").where("collection_date >= first_day")
        now = build_facts(asked.drop("first_day").withColumnRenamed("station_key", "old_key"), stations, "left", "old_key", "bucket")
        off = now.where(~F.col("station_key").eqNullSafe(F.col("old_key"))).groupBy("quarter", "bucket").agg(
            F.count("station_key").alias("moved"), F.count_if(F.col("station_key").isNull()).alias("gone"), F.collect_set(quarter(week_start(F.col("collection_date")))).alias("weeks")).collect()  # a row a partition
        if not off:
            return 0, 0
        named = {(r["quarter"], r["bucket"]) for r in off}
        inside = lambda v: (v["quarter"], int(v["bucket"])) in named
        whole = t.read("facts", _FACTS, inside).drop("station_key")
        t.put("facts", _laid_out(build_facts(whole, stations, "inner", "bucket")), _FACTS_BY, inside, self.fact_rules)
        self._stale(t, {w for r in off for w in r["weeks"]})
        return sum(r["moved"] for r in off), sum(r["gone"] for r in off)

    def add_facts(self, t: Transaction, prices: DataFrame, file: int, quarters: list[str], replace: bool = False) -> tuple[int, int]:
        """Add a file's prices; (facts added, prices that differ from those which the file has stored). Read are the partitions of the quarters
        that the file has, or had before.

        A station, product and day that has a fact keeps it. With ``replace`` the file's own facts make room first."""
        had = t.marks.setdefault("quarters", {}).get(str(file), [])
        grain, every = ["collection_date", "cnpj", "product_key"], sorted({*quarters, *had})
        here = lambda v: v["quarter"] in every
        known, own = t.read("facts", _FACTS, here), F.col("source_file_id") == file
        stations, asked = t.read("stations", STATION + _BUCKET), prices.withColumn("bucket", self.bucket())
        differing = 0
        if had:
            stored = known.where(own).select(*grain, F.col("sale_price").alias("stored"))
            differing = asked.join(stored, grain).where("sale_price <> stored").count()
        t.marks["quarters"][str(file)] = every
        weeks = {"weeks": F.collect_set(quarter(week_start(F.col("collection_date"))))}
        if replace and had:
            rest, before = known.where(~own), known.where(own).agg(F.collect_set(quarter(week_start(F.col("collection_date")))).alias("w"), F.count(F.lit(1)).alias("n")).first()
            new = build_facts(asked.join(rest.select(*grain), grain, "left_anti"), stations, "inner", "bucket")
            got = t.put("facts", _laid_out(rest.select(*new.columns).unionByName(new)), _FACTS_BY, here, self.fact_rules, weeks | {"own": F.count_if(own)})
            self._stale(t, {*got["weeks"], *before["w"]})
            return got["own"] - before["n"], differing
        new = build_facts(asked.join(known.select(*grain), grain, "left_anti"), stations, "inner", "bucket")
        got = t.append("facts", _laid_out(new), _FACTS_BY, self.fact_rules, weeks)
        self._stale(t, set(got["weeks"] or []))
        return got["rows"], differing

    @staticmethod
    def _stale(t: Transaction, quarters: set[str]) -> None:
        """Quarters, by their weeks' Mondays, in which the rollup is behind the facts."""
        t.marks["stale"] = sorted({*t.marks.get("stale", []), *quarters})

    # Brands

    def merge_brand(self, duplicate: str, canonical_name: str) -> None:
        """Let a brand go into another for good: kept as an edge, it also holds for snapshots that are there and files to come."""
        with self.step("merge_brand") as step, self.tables.transaction() as t:
            stations, brands = t.read("stations", STATION + _BUCKET), t.read("brands", BRAND)
            keys = {r["brand_name"]: r["brand_key"] for r in brands.where(F.col("brand_name").isin(duplicate, canonical_name)).collect()}
            left, aliases, _ = merge_brand(brands, t.read("aliases", ALIAS), stations, duplicate, canonical_name)
            t.replace("brands", left.coalesce(1))
            t.replace("aliases", aliases.coalesce(1))
            edge = self.spark.createDataFrame([(keys[duplicate], keys[canonical_name])], "brand_key int, into_key int").withColumn("merged_at", F.current_timestamp())
            t.append("merges", edge.coalesce(1))
            moved = stations.where(F.col("brand_key") == keys[duplicate]).groupBy("cnpj", "bucket").agg(F.min("valid_from").alias("first_day"))
            changed = self._note_changes(t, moved)
            self._build_versions(t, changed)
            step.rows_in, step.rows_out = changed["rows"], self._restate(t, changed)[0]
            t.drop("changes")

    def review_brands(self, *names: str) -> None:
        """Note that brands have been looked at and are brands of their own."""
        with self.step("review") as step, self.tables.transaction() as t:
            step.rows_out = t.replace("brands", review(t.read("brands", BRAND), names).coalesce(1), counts={"n": F.count_if(F.col("brand_name").isin(*names))})["n"]

    # Reading

    def facts(self) -> DataFrame:
        return self.tables.read("facts", _FACTS)

    def facts_of(self, *cnpj: str, since: str | None = None) -> DataFrame:
        """Facts of some stations, from a day on: only the buckets where these live, and the quarters from then on, are listed and read."""
        asked = self.spark.createDataFrame([(c,) for c in cnpj], "cnpj string")
        homes = {r["bucket"] for r in asked.select(self.bucket()).distinct().collect()}  # buckets at most
        first = self.spark.range(1).select(quarter(F.lit(since).cast("date")).alias("q")).first()["q"] if since else ""
        here = lambda v: int(v["bucket"]) in homes and (v["quarter"] >= first or first == "default")
        found = self.tables.snapshot().read("facts", _FACTS, here).where(F.col("cnpj").isin(*cnpj))
        return found.where(F.col("collection_date") >= F.lit(since).cast("date")) if since else found

    def stations(self) -> DataFrame:
        return self.tables.read("stations", STATION + _BUCKET)

    def rejects(self) -> DataFrame:
        return self.tables.read("rejects", REJECT)

    def weekly(self) -> DataFrame:
        return self.tables.read("weekly", WEEKLY)

    def refresh(self, whole: bool = False) -> None:
        """Bring the weekly rollup up to date. Percentiles of parts don't merge, so weeks are computed anew, but only in the quarters whose facts
        have changed since; other partitions stay as they are."""
        with self.step("refresh") as step, self.tables.transaction() as t:
            stations, at = t.read("stations", STATION + _BUCKET), quarter(week_start(F.col("collection_date")))
            stale = None if whole or not t.has("weekly") else set(t.marks.get("stale", []))
            wanted = (lambda v: True) if stale is None else (lambda v: v["quarter"] in stale or any(v["quarter"] == _after(q) for q in stale))
            facts = t.read("facts", _FACTS, wanted)
            facts = facts if stale is None else facts.where(at.isin(*stale))
            if stale != set():
                rolled = weekly_rollup(facts, stations).withColumn("quarter", quarter(F.col("week_start_date"))).repartition("quarter")
                step.rows_out = t.put("weekly", rolled, ("quarter",), (lambda v: True) if stale is None else (lambda v: v["quarter"] in stale))["rows"]
            t.marks["stale"] = []

    def verify(self) -> None:
        """Raise on the first structural rule that a row of the stored tables breaks: those that need more than the row, too."""
        s = self.tables.snapshot()
        checks.require(checks.broken(s.read("stations", STATION), s.read("facts", FACT), s.read("brands", BRAND), s.read("cities", CITY), s.read("aliases", ALIAS)))

    def model(self) -> Model:
        """What views and questions read, all of one commit. Days and products bound partitions and row groups of the facts."""
        s = self.tables.snapshot()
        return Model(s.read("facts", FACT), s.read("stations", STATION), s.read("cities", CITY), self.products, s.read("brands", BRAND), CALENDAR, s.read("weekly", WEEKLY))

    def table_sizes(self) -> DataFrame:
        """(table, quarter, files, bytes) of what is stored: of facts by quarter, of other tables whole."""
        rows, now = None, self.tables.snapshot()
        for name in ("facts", "stations", "weekly", "rejects", "snapshots"):
            if folders := now.folders(name):
                files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folders)
                label = F.nullif(F.regexp_extract("path", "/quarter=([^/]+)/", 1), F.lit("")) if name == "facts" else F.lit(None).cast("string")
                own = files.select(F.lit(name).alias("table"), label.alias("quarter"), "length").groupBy("table", "quarter").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
                rows = own if rows is None else rows.unionByName(own)
        return rows


_CHANGES = "cnpj string, bucket int, first_day date"
_FACTS, _FACTS_BY = FACT + _BUCKET, ("quarter", "bucket")


def _of_file(file: int) -> Callable[[dict[str, str]], bool]:
    return lambda v: v["source_file_id"] == str(file)


def _after(q: str) -> str:
    """The quarter after one, as a label; 'default' has none."""
    return q if "q" not in q else f"{int(q[:4]) + (q[5] == '4')}q{int(q[5]) % 4 + 1}"


def _laid_out(facts: DataFrame) -> DataFrame:
    """Facts in their stored columns, a file a partition, in the order in which questions meet them."""
    return facts.select(*_names(_FACTS)).repartition("quarter", "bucket").sortWithinPartitions("quarter", "bucket", "product_key", "station_key", "collection_date")


def _by_quarter(facts: DataFrame) -> DataFrame:
    """Facts in their stored columns, few files a quarter, in the order in which questions meet them."""
    columns = [c.split()[0] for c in FACT.split(", ")]
    return facts.select(*columns).repartition("quarter", F.pmod(F.xxhash64("station_key"), F.lit(16))).sortWithinPartitions("quarter", "product_key", "station_key", "collection_date")


def written_model(spark: SparkSession, folder: str, stations: Callable[[], DataFrame], prices: Callable[[], DataFrame], columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, stations, weekly rollup) from a folder, written there first if it lacks them; ``columns`` are those of the stations, so that
    no file is opened to find them out."""
    tables = Tables(spark, folder)
    if not tables.has("weekly"):
        try:
            with tables.transaction() as t:
                t.replace("stations", stations())
                versions = t.read("stations", columns)
                t.replace("facts", _by_quarter(build_facts(prices(), versions)), ("quarter",))
                t.replace("weekly", weekly_rollup(t.read("facts", FACT), versions))
        except Conflict:
            pass  # another session has written the same
    now = tables.snapshot()
    return now.read("facts", FACT), now.read("stations", columns), now.read("weekly", WEEKLY)


def load_order(catalog: DataFrame) -> DataFrame:
    """Files that are still to be loaded, in the order of their periods."""
    return catalog.where(F.col("status") != LOADED).withColumn("turn", F.row_number().over(Window.orderBy("period_start"))).select("turn", "source_file_id", "file_name", "status")
