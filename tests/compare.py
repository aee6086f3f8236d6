"""Rows of a Spark query and of SQL in DuckDB, made comparable."""

import os

import duckdb
import pandas as pd


def database(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        c.sql(f"create view {f[:-8]} as select * from '{path}'")
    return c


def plain(x) -> str:
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return ""
    if isinstance(x, float):
        return repr(round(x, 6))
    if isinstance(x, pd.Timestamp):
        return str(x.tz_localize(None) if x.tzinfo else x)
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))
