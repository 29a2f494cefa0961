"""Runs a query in Spark and its SQL in DuckDB and compares schema names and rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if hasattr(x, "as_tuple"):
        return round(float(x), 6)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(_plain(r[i])) for i in order) for r in rows)


def differences(spark_df, con, sql: str):
    """None, or what differs."""
    got_names, got = spark_df.columns, spark_df.collect()
    cur = con.execute(sql)
    want_names, want = [c[0] for c in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} and {sorted(want_names)}"
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if a == b:
        return None
    pairs = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:2]
    return f"{len(a)} and {len(b)} rows; {pairs}"
