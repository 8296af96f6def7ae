"""Comparing a query's rows with those of its SQL, whatever their order."""

from __future__ import annotations

import decimal
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def database(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(d):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{d}/{f}')")
    return c


def assert_same(df, sql: str, d: str) -> None:
    c = database(d)
    names = sorted(df.columns)
    assert names == sorted(c.sql(sql).columns)
    got = sorted(repr(tuple(norm(r[n]) for n in names)) for r in df.collect())
    want = sorted(repr(tuple(map(norm, r))) for r in c.sql("select " + ", ".join(f'"{n}"' for n in names) + f" from ({sql})").fetchall())
    assert got == want
