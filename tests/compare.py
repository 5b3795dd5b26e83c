"""Spark results against DuckDB's, rows sorted, floats to five digits."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tables(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.5f}") + 0.0
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def same(spark_df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    have = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if have[0] != want[0]:
        return f"columns {have[0]} {want[0]}"
    if len(have[1]) != len(want[1]):
        return f"{len(have[1])} rows, not {len(want[1])}"
    diff = [(a, b) for a, b in zip(have[1], want[1], strict=True) if a != b]
    return f"{len(diff)} rows differ: {diff[:2]}" if diff else ""
