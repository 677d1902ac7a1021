"""Spark results against DuckDB results on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return con


def shown(value) -> str:
    return repr(round(value, 6)) if isinstance(value, float) else repr(value)


def compare(df, con, sql: str) -> None:
    got_rows = df.collect()
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted([shown(r[c]) for c in order] for r in got_rows)
    want = sorted([shown(r[names.index(c)]) for c in order] for r in result.fetchall())
    assert got == want
