"""Contracts between steps: aligned replies, complete grids, equal identities, chat structure (inventory C, G, J, K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zip_by_index(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """Two tables joined by their explicit row index; a row that only one side has keeps nulls and `both` false.

    The index must be a column of the data: the order of rows is no property of a table.
    """
    a, b = left.withColumn("_a", F.lit(True)), right.withColumn("_b", F.lit(True))
    both = (F.col("_a") & F.col("_b")).eqNullSafe(True)
    return a.join(b, index, "full").withColumn("both", both).drop("_a", "_b")


def align_replies(requests: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """(`key`, `state`) of what breaks the contract one request, one reply: missing, unknown or repeated."""
    n = replies.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    asked = requests.select(key).distinct().withColumn("asked", F.lit(True))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return asked.join(n, key, "full").withColumn("state", state).filter("state is not null").select(key, "state")


def same_identity(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(`key`, `same`): null-safe equality of the identity columns of two receipts."""
    right = b.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(right, key).select(key, same.alias("same"))


def roles_valid(messages: Column, shapes: tuple[tuple[str, ...], ...] = (("system", "user", "assistant"), ("user", "assistant"))) -> Column:
    """Whether the roles of a chat are one of the allowed sequences and no content is blank."""
    roles = F.transform(messages, lambda m: m["role"])
    shaped = F.lit(False)
    for shape in shapes:
        shaped = shaped | (roles == F.array(*map(F.lit, shape)))
    return F.coalesce(shaped & F.forall(messages, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) != ""), F.lit(False))


def exclusive(df: DataFrame, keys: dict[str, Column], side: str) -> DataFrame:
    """(`kind`, `key`) of every key of any kind that occurs on more than one side; null keys are on none."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in keys.items()))
    rows = df.filter(F.col(side).isNotNull()).select(side, F.explode(kinds).alias("k")).select(side, "k.kind", "k.key").filter("key is not null")
    return rows.groupBy("kind", "key").agg(F.min(side).alias("a"), F.max(side).alias("b")).filter("a <> b").select("kind", "key")


def may_evaluate(split: Column, partial: Column, declared: Column) -> Column:
    """Only validation rows while an epoch is partial, and then only on a declared panel; test rows wait for the end."""
    return F.when(partial, (split == "validation") & declared).otherwise(split.isin("validation", "test"))
