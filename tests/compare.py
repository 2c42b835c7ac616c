"""Runs a registered query in Spark and its SQL in DuckDB, and compares rows, names and value kinds."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return ("f", repr(value))
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    return (type(value).__name__, value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both give the same rows; else a short description."""
    got_columns, got = df.columns, df.collect()
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    a, b = rows_of(got_columns, got), rows_of(want_columns, want)
    if a != b:
        only_a, only_b = list((a - b).elements())[:3], list((b - a).elements())[:3]
        return f"{len(got)} vs {len(want)} rows; columns {sorted(got_columns)}\n  spark only {only_a}\n  sql only {only_b}"
    return None
