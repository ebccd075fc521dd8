"""Spark queries against their SQL in DuckDB over the same files."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    """One form for equal values of either engine."""
    if x is None or isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        x = float(x)
        return None if math.isnan(x) else (x + 0.0)
    return str(x)


def key(row):
    return tuple((x is None, str(x)) for x in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def difference(df, con, sql: str) -> str:
    """What differs, or the empty string."""
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    want_names, want = rows_of([c[0] for c in found.description], found.fetchall())
    if got_names != want_names:
        return f"columns {got_names} and {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows: {bad[0][0]} and {bad[0][1]}" if bad else ""
