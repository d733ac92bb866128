"""Run a registered query and its SQL side by side and compare whole results."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _rows(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple((r[i] is not None, r[i]) for i in order) for r in rows)


def compare(spark, con, make, sql: str, sf_dir: str) -> tuple[int, str | None]:
    """``(number of rows, first difference or None)``."""
    df = make(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want_rows = result.fetchall()
    if sorted(df.columns) != sorted(want_columns):
        return len(got_rows), f"columns {sorted(df.columns)} / {sorted(want_columns)}"
    got, want = _rows(df.columns, got_rows), _rows(want_columns, want_rows)
    if len(got) != len(want):
        return len(got), f"rows {len(got)} / {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return len(got), f"{a} / {b}"[:1500]
    return len(got), None
