"""Holding a query's rows against DuckDB's on the same tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "as_tuple"):
        return float(x) if x != int(x) else int(x)
    return x


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def duck(sql: str, folder=DATA) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    return sorted(d[0] for d in got.description), rows_of([d[0] for d in got.description], got.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())
