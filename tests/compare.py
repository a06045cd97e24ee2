"""Compare a query with its checking SQL: columns, rows and values."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations",
]


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    return v


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> tuple[str, int]:
    """('' if equal else what differs, number of rows)."""
    left_cols = df.columns
    left = rows_of(left_cols, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    right_cols = [d[0] for d in rel.description]
    right = rows_of(right_cols, rel.fetchall())
    if sorted(left_cols) != sorted(right_cols):
        return f"columns {sorted(set(left_cols) ^ set(right_cols))}", sum(left.values())
    if left != right:
        a, b = list((left - right).items())[:2], list((right - left).items())[:2]
        return f"{sum(left.values())} vs {sum(right.values())} rows of {sorted(left_cols)}\n  only here: {a}\n  only there: {b}", sum(left.values())
    return "", sum(left.values())
