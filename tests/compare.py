"""Runs a catalogue query next to its SQL and compares them as bags of rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def duck(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, int) and not isinstance(v, bool):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(plain(r[k]) for k in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def difference(spark, sf: str, name: str, fn, sql: str) -> str | None:
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duck(sf)
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        return f"{len(got[1])} rows vs {len(want[1])}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    if not got[1]:
        return "both empty"
    return None
