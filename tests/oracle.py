"""Runs queries in Spark and their SQL in DuckDB and compares rows."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def _value(v):
    if v is None or isinstance(v, (bool, str, bytes)):
        return repr(v)
    if isinstance(v, (float, Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else repr(round(f, 6) + 0.0)
    if isinstance(v, int):
        return repr(float(v)) if False else str(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_value, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_value(x)}" for k, x in v.items()) + "}"
    return str(v)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in data)


def compare(spark, con, name, query, sql, sf_dir) -> str:
    """'' where both agree, else what differs."""
    df = query(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = rows(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"{name}: {len(ours)} and {len(theirs)} rows; only ours {sorted(set(ours) - set(theirs))[:2]}, only SQL {sorted(set(theirs) - set(ours))[:2]}"
    if ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        return f"{name}: {len(bad)} rows differ, e.g. {[str(x)[:600] for x in bad[0]]}"
    return ""
