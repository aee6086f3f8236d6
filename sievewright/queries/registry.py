"""The registry of queries: a callable by name and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def counted(sql: str) -> str:
    """`count_if(x)`, a HUGEINT in DuckDB, as a count, which is a BIGINT like Spark's."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(case when {sql[at + len('count_if(') : end - 1]} then 1 end){sql[end:]}"
    return sql


def query(sql: str | None = None):
    """Register a function under its own name, with SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = counted(sql)
        return f

    return register
