"""Side-by-side comparison of a Spark query with DuckDB SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        files = sorted(glob.glob(f"{p}/*.parquet")) if os.path.isdir(p) else [p]
        c.read_parquet(files).create_view(t)
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 5)
    return int(v) if isinstance(v, bool) else v


def rows_of(columns, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))


def differences(spark_df, con, sql: str) -> list:
    """Empty if both give the same columns and rows."""
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    want = rows_of([x[0] for x in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return [("columns", got[0], want[0])]
    if len(got[1]) != len(want[1]):
        return [("count", len(got[1]), len(want[1])), *list(set(map(str, got[1])) ^ set(map(str, want[1])))[:3]]
    close = lambda x, y: x == y or isinstance(x, float) and isinstance(y, (float, int)) and abs(x - y) <= 2e-5 * max(1, abs(x))
    return [(a, b) for a, b in zip(got[1], want[1], strict=True) if not all(close(x, y) for x, y in zip(a, b, strict=True))][:3]
