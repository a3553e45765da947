"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def same(df, sql: str, sf_dir: str) -> None:
    db = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    want = db.sql(sql)
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    expected = sorted(str(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got == expected
