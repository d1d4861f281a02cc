"""Runs queries beside their SQL on the same tables and compares rows as the driver does."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(columns: list[str], got: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.datetime) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in got), key=repr)


def differ(spark, c, sf_dir: str, query, sql: str) -> str:
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    r = c.sql(sql)
    theirs = rows(r.columns, r.fetchall())
    if sorted(df.columns) != sorted(r.columns):
        return f"columns {df.columns} {r.columns}"
    if mine != theirs:
        a = [x for x in mine if x not in theirs][:2] if len(mine) < 5000 else [x for x, y in zip(mine, theirs, strict=False) if x != y][:2]
        b = [x for x in theirs if x not in mine][:2] if len(mine) < 5000 else [y for x, y in zip(mine, theirs, strict=False) if x != y][:2]
        return f"{len(mine)} rows, {len(theirs)}: {a} {b}"
    return ""
