"""First-per-group, capped picks, batches and running figures (inventory E and F).

Ties are broken by the identifiers given, so every result is the same in any order of rows. Windows are partitioned by
the group; where one group may hold a large share of the rows, `first_per_group` aggregates instead of sorting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.sources.shared import materialize


def first_per_group(df: DataFrame, group: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The first row of each group in `order`, by one aggregate with partial results on the map side."""
    best = df.groupBy(*group).agg(F.min_by(F.struct(*keep), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("_first"))
    return best.select(*group, *(F.col(f"_first.{c}").alias(c) for c in keep))


def at_most(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """At most `n` rows per group; Spark keeps only `n` per group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def priority_dedup(df: DataFrame, key: str, order: list[Column], ident: str) -> tuple[DataFrame, DataFrame]:
    """(survivors, duplicates) by `key`, the first in `order` surviving.

    Survivors come from one aggregate, duplicates from an anti-join on the identifier, so no key's rows are ever sorted
    together, however many they are. Null keys are one key; identifiers must be unique.
    """
    first = F.min_by(ident, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias(ident)
    kept = materialize(df.groupBy(key).agg(first).select(ident), "kept")
    return df.join(kept, ident, "left_semi"), df.join(kept, ident, "left_anti")


def hash_ranks(df: DataFrame, group: list[str], rank: str, ties: list[str], digits: int = 3) -> DataFrame:
    """Each row with its `place` from 1 in the order of a hex digest, or another string, within its group.

    Rows are numbered inside the ranges of the string's first characters, and ranges by the counts before them, so a
    group of any size is spread over 16^digits parts. Null groups are groups; the string must not be null.
    """
    return _ranked(df.withColumn("_range", F.substring(rank, 1, digits)), group, rank, ties).select(*df.columns, "place")


def _ranked(cut: DataFrame, group: list[str], order: str, ties: list[str]) -> DataFrame:
    """`place` of each row: its number inside its `_range` and the counts of the ranges before."""
    counts = cut.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_n")
    offsets = counts.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_range").alias("_r"), before.alias("_before"))
    on = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    local = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(order, *ties))
    return cut.withColumn("_local", local).join(offsets, on).withColumn("place", F.col("_before") + F.col("_local"))


def range_ranks(df: DataFrame, group: list[str], number: str, ties: list[str], parts: int = 1024) -> DataFrame:
    """Each row with its `place` from 1 in the order of a whole number within its group, as `hash_ranks` has it.

    The numbers between the least and the greatest are cut into `parts` ranges of one width, so a group of any size is
    spread over them. Null numbers come first.
    """
    ends = df.agg(F.min(number).alias("low"), F.max(number).alias("high")).first()
    low, width = ends["low"] or 0, max(1, -(-((ends["high"] or 0) - (ends["low"] or 0) + 1) // parts))
    bucket = F.coalesce(F.floor((F.col(number) - low) / width), F.lit(-1))
    return _ranked(df.withColumn("_range", bucket), group, number, ties).select(*df.columns, "place")


def batches(df: DataFrame, group: list[str], number: str, size: int) -> DataFrame:
    """Rows numbered within their group in the order of a whole number and cut into batches of `size`."""
    return range_ranks(df, group, number, []).withColumn("batch", F.floor((F.col("place") - 1) / size))


def trailing(group: list[str], order: list[Column], rows: int):
    """The window of a row and the `rows` - 1 before it."""
    return Window.partitionBy(*group).orderBy(*order).rowsBetween(1 - rows, 0)


def round_robin(df: DataFrame, style: str, order: list[Column], n: int, head_start: dict[str, int] | None = None) -> DataFrame:
    """`n` rows taken in turn from each style, a style that has a head start waiting for the others.

    The closed form of the loop: with c of a style taken before, its j-th row comes at turn c + j - 1, styles in order.
    """
    start = F.lit(0)
    for name, c in (head_start or {}).items():
        start = F.when(F.col(style) == name, c).otherwise(start)
    # Of a style at most n rows count, so Spark keeps no more of each before the shuffle.
    first = at_most(df, [style], order, max(n, 0))
    return first.withColumn("turn", F.col("place") - 1 + start).drop("place").orderBy("turn", style, *order).limit(n)
