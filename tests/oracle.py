"""Compare a Spark result with the SQL answer on the same tables."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(folder, name)}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def kind(v):
    return type(v).__name__ if v is not None else None


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want_cols, want = rows_of(cols, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first {got[:2]} | {want[:2]}"
    for a, b in zip(got, want):
        if a != b or [kind(x) for x in a] != [kind(x) for x in b]:
            return f"{got_cols}: {a} != {b}"
    return None
