"""Folders that driver and executors share, and tables in them that change together.

A commit is one small file that names the folders of all tables; it appears whole or not at all. Writers put rows into new
folders, never into one that a commit names, and publish a commit that follows the one they began from. So a writer that dies
leaves every table as it was, of two writers that began from one commit only the first gets through, and a reader who holds a
commit sees the tables of one moment.
"""

from __future__ import annotations

import functools
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temp folder in local mode if it is unset."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(_local[sc.applicationId])
    return _local[sc.applicationId]


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _path(spark, path)
    return system.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, system = _path(spark, path)
    system.delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, ascending; none if it doesn't exist."""
    at, system = _path(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def leaves(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the data files at a path or right in the folder there, by path."""
    at, system = _path(spark, path)
    found = [(s.getPath().toString(), s.getLen()) for s in system.listStatus(at) if s.isFile()]
    return sorted(f for f in found if not f[0].rpartition("/")[2].startswith(("_", ".")))


def state(spark: SparkSession, *paths: str) -> str:
    """A digest of names, sizes and times of the files at some paths, or in folders there: it changes when they do."""
    seen = []
    for path in paths:
        at, system = _path(spark, path)
        for s in sorted(system.listStatus(at), key=lambda s: s.getPath().toString()):
            seen.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(repr(seen).encode()).hexdigest()[:24]


@functools.cache
def code_state() -> str:
    """A digest of the package's code but the text operators': what was written by other code is not read."""
    root = Path(__file__).parent
    return hashlib.sha256(b"".join(p.read_bytes() for p in sorted(root.rglob("*.py")) if "llm" not in p.parts)).hexdigest()[:12]


def derived_dir(spark: SparkSession, name: str, *inputs: str) -> str:
    """The folder of tables that this code derives from input files in their present state. Folders of the same name and
    inputs that another state or other code has left are deleted."""
    base = f"{shared_dir(spark)}/tidemark"
    stem = f"{name}-{hashlib.sha256(repr(inputs).encode()).hexdigest()[:12]}-"
    own = f"{stem}{state(spark, *inputs)}-{code_state()}"
    for old in children(spark, base):
        if old.startswith(stem) and old != own:
            delete(spark, f"{base}/{old}")
    return f"{base}/{own}"


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file that appears whole; False if there is one already."""
    at, system = _path(spark, path)
    draft = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    out = system.create(_path(spark, draft)[0], True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop
    context = jvm.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else system.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    none = spark.sparkContext._gateway.new_array(jvm.fs.Options.Rename, 0)
    try:
        context.rename(_path(spark, draft)[0], at, none)  # refuses to replace a file
    except Exception:
        delete(spark, draft)
        if not exists(spark, path):
            raise
        return False
    return True


def get_text(spark: SparkSession, path: str) -> str:
    at, system = _path(spark, path)
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


class RuleBroken(ValueError):
    """Rows that were being written break a rule, so nothing of the transaction is committed."""


#: Commits whose folders stay, for readers that are under way.
KEEP = 3


class Tables:
    """Named tables under one folder, each in partitions by some columns or in one.

    ``spark.read`` gets the folders that the current commit names, so partition columns prune as usual."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in children(self.spark, f"{self.folder}/_commits") if n.endswith(".json") and not n.startswith(".")]

    def _load(self, number: int) -> dict:
        return json.loads(get_text(self.spark, self._commit_path(number))) if number else {"tables": {}, "marks": {}}

    def _commit_path(self, number: int) -> str:
        return f"{self.folder}/_commits/{number:012d}.json"

    def snapshot(self) -> Snapshot:
        """The tables as of now."""
        number = max(self._numbers(), default=0)
        return Snapshot(self, number, self._load(number))

    def read(self, name: str, schema: str | StructType) -> DataFrame:
        return self.snapshot().read(name, schema)

    def has(self, name: str) -> bool:
        return self.snapshot().has(name)

    @contextmanager
    def transaction(self):
        """Changes that become visible together when the block ends, or not at all if it raises."""
        own = Transaction(self)
        try:
            yield own
            own.commit()
        except BaseException:
            own.discard()
            raise

    def vacuum(self) -> int:
        """Delete folders that no kept commit names, as writers that died have left them; the number deleted. Run it while nobody writes."""
        kept = {f.split("/")[1] for n in self._numbers() for f in _folders(self._load(n))}
        gone = [f"{t}/{load}" for t in children(self.spark, self.folder) if not t.startswith("_") for load in children(self.spark, f"{self.folder}/{t}") if load.startswith("load=") and load not in kept]
        for path in gone:
            delete(self.spark, f"{self.folder}/{path}")
        return len(gone)


class Snapshot:
    def __init__(self, tables: Tables, number: int, content: dict) -> None:
        self.tables, self.number, self.content = tables, number, content

    def has(self, name: str) -> bool:
        return name in self.content["tables"]

    def parts(self, name: str) -> dict[str, list[str]]:
        """Folders by partition, as "column=value/column=value"."""
        return self.content["tables"].get(name, {})

    @property
    def marks(self) -> dict:
        """Small facts that are committed with the tables."""
        return self.content["marks"]

    def read(self, name: str, schema: str | StructType, keep: Callable[[dict[str, str]], bool] | None = None) -> DataFrame:
        """A table, or the partitions whose values ``keep`` wants; no rows if there is none."""
        spark, base = self.tables.spark, f"{self.tables.folder}/{name}"
        paths = sorted({f"{self.tables.folder}/{f}" for part, folders in self.parts(name).items() if keep is None or keep(values(part)) for f in folders})
        if not paths:
            return spark.createDataFrame([], schema)
        found = spark.read.schema(schema).option("basePath", base).parquet(*paths)
        names = (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).names
        return found.select(*[F.col(f"`{n}`") for n in names])

    def folders(self, name: str) -> list[str]:
        return sorted({f"{self.tables.folder}/{f}" for folders in self.parts(name).values() for f in folders})


def values(part: str) -> dict[str, str]:
    """Columns and values of a partition."""
    return dict(c.split("=", 1) for c in part.split("/") if c)


def _folders(content: dict) -> set[str]:
    return {f for parts in content["tables"].values() for folders in parts.values() for f in folders}


class Transaction(Snapshot):
    """A snapshot that is being changed; reads see its own changes."""

    def __init__(self, tables: Tables) -> None:
        base = tables.snapshot()
        super().__init__(tables, base.number, json.loads(json.dumps(base.content)))
        self.base, self.written, self.done = base, [], False

    def _folder(self, name: str) -> str:
        self.written.append(f"{name}/load={uuid.uuid4().hex}")
        return self.written[-1]

    def _write(self, name: str, df: DataFrame, by: tuple[str, ...], rules: dict[str, str] | None, counts: dict[str, Column] | None) -> tuple[dict[str, list[str]], dict[str, int]]:
        """Rows go into a new folder; the same pass counts them, and those that break a rule (SQL that must be true)."""
        folder, rules = self._folder(name), rules or {}
        seen = Observation()
        asked = {"rows": F.count(F.lit(1)), **(counts or {}), **{f"rule{i}": F.count_if(~F.coalesce(F.expr(c), F.lit(False))) for i, c in enumerate(rules.values())}}
        observed = df.observe(seen, *[c.alias(k) for k, c in asked.items()])
        (observed.write.partitionBy(*by) if by else observed.write).parquet(f"{self.tables.folder}/{folder}")
        got = {k: seen.get.get(k) or 0 for k in asked}
        for i, rule in enumerate(rules):
            if got.pop(f"rule{i}"):
                raise RuleBroken(f"rule broken: {name}: {rule}")
        return {p: [f"{folder}/{p}".rstrip("/")] for p in self._found(folder, len(by))}, got

    def _found(self, folder: str, depth: int, part: str = "") -> list[str]:
        if not depth:
            return [part]
        inside = [n for n in children(self.tables.spark, f"{self.tables.folder}/{folder}/{part}") if "=" in n]
        return [p for n in inside for p in self._found(folder, depth - 1, f"{part}/{n}".lstrip("/"))]

    def replace(self, name: str, df: DataFrame, by: tuple[str, ...] = (), rules: dict[str, str] | None = None, counts: dict[str, Column] | None = None) -> dict[str, int]:
        """The whole table; what was counted."""
        self.content["tables"][name], got = self._write(name, df, by, rules, counts)
        return got

    def append(self, name: str, df: DataFrame, by: tuple[str, ...] = (), rules: dict[str, str] | None = None, counts: dict[str, Column] | None = None) -> dict[str, int]:
        new, got = self._write(name, df, by, rules, counts)
        if got["rows"] or not self.has(name):
            own = self.content["tables"].setdefault(name, {})
            for part, folders in new.items():
                own.setdefault(part, []).extend(folders)
        return got

    def put(self, name: str, df: DataFrame, by: tuple[str, ...], gone: Callable[[dict[str, str]], bool], rules: dict[str, str] | None = None, counts: dict[str, Column] | None = None) -> dict[str, int]:
        """Replace the partitions that ``gone`` names by those of df; a partition of which nothing comes back is empty then."""
        new, got = self._write(name, df, by, rules, counts)
        own = {p: f for p, f in self.parts(name).items() if not gone(values(p))}
        for part, folders in new.items():
            own[part] = own.get(part, []) + folders
        self.content["tables"][name] = own
        return got

    def put_files(self, name: str, write: Callable[[str], None]) -> None:
        """A table of another format, written by ``write`` into the folder that it gets."""
        folder = self._folder(name)
        write(f"{self.tables.folder}/{folder}")
        self.content["tables"][name] = {"": [folder]}

    def drop(self, *names: str) -> None:
        for name in names:
            self.content["tables"].pop(name, None)

    def commit(self) -> None:
        """Publish the changes; nothing more if that was done."""
        if self.done:
            return
        spark, number = self.tables.spark, self.number + 1
        if max(self.tables._numbers(), default=0) != self.number or not put_new(spark, self.tables._commit_path(number), json.dumps(self.content)):
            raise Conflict(f"{self.tables.folder} was changed by another writer; begin again")
        self.done = True
        kept = _folders(self.content)
        self._delete(f for f in self.written if not any(k == f or k.startswith(f"{f}/") for k in kept))
        for old in [n for n in self.tables._numbers() if n <= number - KEEP]:
            later = {f for n in self.tables._numbers() if n > old for f in _folders(self.tables._load(n))}
            self._delete(_folders(self.tables._load(old)) - later)
            delete(spark, self.tables._commit_path(old))

    def discard(self) -> None:
        if not self.done:
            self._delete(self.written)

    def _delete(self, folders: Iterable[str]) -> None:
        for f in folders:
            delete(self.tables.spark, f"{self.tables.folder}/{f}")


class Ledger:
    """Notes on runs, a small file each, in numbered order; notes of runs that have ended are gathered into one file in time."""

    GATHER = 200

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def begin(self, note: dict) -> dict:
        """Note a run under the next free number, which it gets as run_id."""
        self._gather()
        taken = [int(n.split("-")[0]) for n in children(self.spark, self.folder) if n[0] != "."]
        number = max(taken, default=0) + 1
        while not put_new(self.spark, f"{self.folder}/{number:012d}-begun.json", json.dumps(own := note | {"run_id": number})):
            number += 1
        return own

    def end(self, note: dict) -> None:
        put_new(self.spark, f"{self.folder}/{note['run_id']:012d}-ended.json", json.dumps(note))

    def _gather(self) -> None:
        names = [n for n in children(self.spark, self.folder) if n[0] != "."]
        ended = {n.split("-")[0] for n in names if n.endswith("-ended.json")}
        small = [n for n in names if n.endswith(("-begun.json", "-ended.json")) and n.split("-")[0] in ended]
        if len(small) >= self.GATHER:
            text = "\n".join(get_text(self.spark, f"{self.folder}/{n}") for n in small if n.endswith("-ended.json"))
            put_new(self.spark, f"{self.folder}/{max(ended)}-gathered.json", text)
            for n in small:
                delete(self.spark, f"{self.folder}/{n}")

    def read(self, schema: str) -> DataFrame:
        if not children(self.spark, self.folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(self.folder)
