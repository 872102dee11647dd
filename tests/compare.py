"""Runs a query and its SQL on the same tables and compares them value by value."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows(columns, data) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, f, sql: str, d: str) -> str:
    """What differs; empty if nothing does."""
    df = f(spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{d}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    if sorted(df.columns) != sorted(c[0] for c in cur.description):
        return f"columns {sorted(df.columns)} and {sorted(c[0] for c in cur.description)}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"{len(got)} and {len(want)} rows; {diff}"
    return ""
