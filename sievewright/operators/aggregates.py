"""Roll-ups whose denominators stay whole, histograms and exact ranks (inventory D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(hits: Column, base: Column) -> Column:
    """A rate to six places; null where there is nothing to divide by."""
    return F.round(F.try_divide(hits, base), 6)


def evaluation_rollup(df: DataFrame, by: list[str]) -> DataFrame:
    """Cases, attempts, acceptances and both rates per group; `df` has `status` and `accepted`. A missing case is a case."""
    attempted = F.count_if(F.col("status").isin("parsed", "rejected"))
    accepted = F.count_if(F.col("accepted"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), attempted.alias("attempted"), accepted.alias("accepted"), F.count_if(F.col("status") == "missing").alias("missing"),
        rate(accepted, F.count(F.lit(1))).alias("rate_all"), rate(accepted, attempted).alias("rate_attempted"),
    )


def histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per (column, value) of several columns in one pass; nulls are a value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def nearest_ranks(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact values at sorted index floor((n - 1) * share) per group, without interpolation.

    Equal values are counted first, so a group is sorted by its distinct values only and never gathered.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    keys = ", ".join(by)
    part = f"partition by {keys}" if by else ""
    upto = counts.selectExpr("*", f"sum(_n) over ({part} order by {value}) as _upto", f"sum(_n) over ({part}) as _all")
    at = lambda q: F.min(F.when(F.col("_upto") > F.floor((F.col("_all") - 1) * q), F.col(value)))
    return upto.groupBy(*by).agg(*(at(q).alias(name) for name, q in shares.items()), F.max("_all").alias("n"))


def map_sums(df: DataFrame, by: list[str], maps: str) -> DataFrame:
    """Sums of map values by key."""
    return df.select(*by, F.explode(maps).alias("key", "value")).groupBy(*by, "key").agg(F.sum("value").alias("total"))
