"""Spark rows against DuckDB rows of the same tables."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def duck(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        if Path(folder, f"{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c


def _rows(rows: list[tuple], order: list[int]) -> list[tuple]:
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql: str, connection) -> str:
    """What differs in names, types or rows; empty if nothing does."""
    result = connection.sql(sql)
    mine, theirs = sorted(df.columns), sorted(result.columns)
    if mine != theirs:
        return f"columns {mine} and {theirs}"
    kinds = dict(zip(result.columns, map(str, result.types), strict=True))
    if odd := [(n, t, kinds[n]) for n, t in df.dtypes if KINDS.get(t, t) != kinds[n]]:
        return f"types {odd}"
    a = _rows([tuple(r) for r in df.collect()], [df.columns.index(n) for n in mine])
    b = _rows(result.fetchall(), [result.columns.index(n) for n in mine])
    if a != b:
        only = next((x, y) for x, y in zip([*a, None], [*b, None], strict=False) if x != y)
        return f"{len(a)} and {len(b)} rows; first difference {only}"
    return ""
