"""Runs a query's SQL in DuckDB and compares the rows, in any order."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v) -> str:
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 6))
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def rows(columns: list[str], found: list) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def check(con: duckdb.DuckDBPyConnection, df, sql: str) -> None:
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())
