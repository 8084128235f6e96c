"""Runs a query and its SQL over the smallest tables and compares the rows."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb


def _plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 5)
    return v


def same(spark, data: str, query, sql: str) -> None:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, data)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    ours = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert ours == theirs
