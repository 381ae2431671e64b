"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, list | tuple):
        return tuple(map(normal, v))
    return bytes(v) if isinstance(v, bytearray) else v


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return c


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    names = sorted(df.columns)
    ours = sorted((tuple(map(normal, r)) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    assert ours == sorted((tuple(normal(r[i]) for i in at) for r in got.fetchall()), key=repr)
