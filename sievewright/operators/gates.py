"""Row-level gates: issue codes, ladders and routing (inventory K). Nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(checks: dict[str, Column]) -> Column:
    """Sorted codes of the checks that are true; a null check is not true."""
    return F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items()))))


def with_controls(rows: DataFrame, batch: str, controls: DataFrame) -> DataFrame:
    """Known-answer rows added to every batch; `controls` has the columns of `rows` but the batch, and is small by design."""
    return rows.withColumn("control", F.lit(False)).unionByName(rows.select(batch).distinct().crossJoin(controls).withColumn("control", F.lit(True)))


def trusted_batches(judged: DataFrame, batch: str, verdict: Column, expected: Column) -> DataFrame:
    """(batch, trusted): whether all its control rows got the expected verdict."""
    return judged.groupBy(batch).agg(F.bool_and(F.when(F.col("control"), F.coalesce(verdict == expected, F.lit(False))).otherwise(True)).alias("trusted"))
