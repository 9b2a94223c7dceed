"""Spark's rows of a registered query against DuckDB's rows of its SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return v.item()
    if isinstance(v, list | tuple):
        return tuple(_plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same columns and rows; else what differs first."""
    df = query(spark, sf_dir)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b = rows([c[0] for c in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    for x, y in zip(a[1], b[1], strict=True):
        if x != y and not all(u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=2e-6)) for u, v in zip(x, y, strict=True)):
            return f"{x} and {y}"
    return "" if a[1] or not b[1] else "no rows"
