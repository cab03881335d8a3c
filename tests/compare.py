"""Compare a Spark frame with a DuckDB result, column names sorted, rows in any order."""

from __future__ import annotations

import decimal
from collections import Counter

import duckdb

from tablevault.plans.fixtures import ALL_TABLES

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in ALL_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    return tuple(v) if isinstance(v, list) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple((type(_plain(r[i])).__name__, _plain(r[i])) for i in order) for r in rows)


def differences(df, con, sql: str):
    got_names, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        return f"{sum(got.values())} rows, want {sum(want.values())}; extra {list((got - want).items())[:2]}; missing {list((want - got).items())[:2]}"
    return None
