"""Rows of a Spark result and of DuckDB's answer, made comparable."""

from __future__ import annotations

import decimal
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def shown(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if x != x else f"{float(x):.6f}".rstrip("0").rstrip(".") or "0"
    return str(x)


def spark_rows(df) -> tuple[list[str], list[str]]:
    columns = sorted(df.columns)
    return columns, sorted("|".join(shown(r[c]) for c in columns) for r in df.collect())


def duck_rows(con, text: str) -> tuple[list[str], list[str]]:
    made = con.sql(text)
    columns = sorted(made.columns)
    at = [list(made.columns).index(c) for c in columns]
    return columns, sorted("|".join(shown(r[i]) for i in at) for r in made.fetchall())
