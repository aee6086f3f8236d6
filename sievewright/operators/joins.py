"""Joins that keep denominators, check integrity, patch rows or share work (inventory C).

Sides are never forced to be broadcast: Spark decides by their measured size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_cases(cases: DataFrame, outcomes: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Left join that keeps every case; one without an outcome has status `missing`. Null keys match nothing."""
    return cases.join(outcomes.withColumn("_has", F.lit(True)), key, "left").withColumn(status, F.when(F.col("_has"), F.col(status)).otherwise("missing")).drop("_has")


def unknown_keys(rows: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """Rows whose key no case has: what a fail-closed join must find empty."""
    return rows.join(cases.select(key), key, "left_anti")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def guarded_join(left: DataFrame, right: DataFrame, key: str, left_hash: Column, right_hash: Column) -> DataFrame:
    """Join on a key with a column `agrees` that tells whether the content hashes of both sides are equal."""
    return left.withColumn("_l", left_hash).join(right.withColumn("_r", right_hash), key).withColumn("agrees", F.col("_l") == F.col("_r")).drop("_l", "_r")


def exclude(rows: DataFrame, keys: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in none of the given tables. Null keys stay."""
    held = keys[0].select(key)
    for k in keys[1:]:
        held = held.unionByName(k.select(key))
    return rows.join(held.distinct(), key, "left_anti")


def overlay(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Copy-on-write patches: each patched column takes the patch's value where there is one. `patched` tells."""
    named = patches.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_patch"))
    joined = rows.join(named, key, "left")
    changed = {c: F.coalesce(f"_{c}", c) for c in columns}
    return joined.withColumns(changed).withColumn("patched", F.coalesce("_patch", F.lit(False))).drop("_patch", *(f"_{c}" for c in columns))


def paired_arms(rows: DataFrame, case: str, arm: str, before: str, after: str, flag: Column, family: str) -> DataFrame:
    """One row per case that both arms judged: (`case`, `family`, `before`, `after`) by conditional aggregation, no self-join."""
    of = lambda a: F.max(F.when(F.col(arm) == a, flag.cast("int")))
    both = rows.filter(F.col(arm).isin(before, after)).groupBy(case, family).agg(of(before).alias("before"), of(after).alias("after"))
    return both.filter("before is not null and after is not null")


def theta_rules(rows: DataFrame, rules: list[tuple[str, str, str | None]], text: Column, other: Column) -> DataFrame:
    """Rule table against rows: a rule (id, pattern, absent pattern) holds where `text` matches and `other` does not.

    The rules are code, so they become expressions over one scan instead of a nested loop join.
    """
    hit = [F.when(text.rlike(p) & (F.lit(True) if absent is None else ~F.coalesce(other.rlike(absent), F.lit(False))), F.lit(i)) for i, p, absent in rules]
    return rows.withColumn("rule", F.explode(F.array_compact(F.array(*hit))))


def once_per_content(rows: DataFrame, content: Column, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Evaluate distinct contents once and give the result to every row.

    `evaluate` maps a table (`content_hash`, `content`) to (`content_hash`, results). Null contents get nulls.
    """
    keyed = rows.withColumn("content_hash", F.sha2(content, 256))
    distinct = keyed.select("content_hash", content.alias("content")).dropDuplicates(["content_hash"]).filter("content_hash is not null")
    return keyed.join(evaluate(distinct), "content_hash", "left")


def split_by_cache(keys: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(keys already in the cache, keys still to do)."""
    known = cache.select(key).distinct()
    return keys.join(known, key, "left_semi"), keys.join(known, key, "left_anti")


def changed_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of which a column differs, nulls being equal, or that are on one side only, with the kind of change."""
    b = before.select(key, F.struct(*columns).alias("_b"))
    a = after.select(key, F.struct(*columns).alias("_a"))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_b").eqNullSafe(F.col("_a")), "changed")
    return b.join(a, key, "full").withColumn("change", kind).filter("change is not null").select(key, "change")
