"""Comparing a query with its SQL oracle."""

from __future__ import annotations

import os

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = f"{sf}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0 if value else 0.0)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> str:
    """Empty if both give the same rows under the same column names; else what differs."""
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    expected = rows_of(names, answer.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == expected:
        return "" if got else "no rows"
    here, there = set(got), set(expected)
    only = [r for r in got if r not in there][:3]
    miss = [r for r in expected if r not in here][:3]
    return f"{len(got)} rows, expected {len(expected)}; only here {only}; only there {miss}"
