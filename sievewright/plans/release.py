"""Composite plans: steps of a release chained lazily (inventory N11 and the minimum slice)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions import canon, text


def labelled(df: DataFrame) -> DataFrame:
    """Rows that may be released, with their key."""
    rows = df.filter("description <> '' and split is not null")
    return rows.withColumn("key", text.description_key(F.col("description"))).withColumn("rarity", F.coalesce("target.rarity", F.lit("none")))


def deduplicated(df: DataFrame) -> DataFrame:
    """One row per key, held-out rows before training rows, then the smallest example id; a hot key is aggregated in parts."""
    priority = F.when(F.col("split") == "test", 0).when(F.col("split") == "validation", 1).otherwise(2)
    kept = [c for c in df.columns if c != "key"]
    best = df.groupBy("key").agg(F.min_by(F.struct(*kept), F.struct(priority.alias("p"), F.col("example_id"), F.col("row_id"))).alias("r"))
    return best.select("key", "r.*")


def named(df: DataFrame) -> DataFrame:
    """A composed name in place of the own one for a quarter of the rows, by the hash of their identifier."""
    n = canon.hash_number(canon.digest_string("example_id"))
    return df.withColumn("name", F.when(n % 4 == 0, text.composed_name(n)).otherwise(F.col("target.name")))


def validated(df: DataFrame) -> DataFrame:
    """Whether a row has what a release needs."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return df.withColumn("valid", filled(F.col("name")) & filled(F.col("target.type_line")) & F.col("target.oracle_text").isNotNull())


def exported(df: DataFrame) -> DataFrame:
    """Prompt and compact JSON completion."""
    design = F.struct("name", *(F.col(f"target.{f}") for f in ("type_line", "oracle_text", "mana_cost")))
    return df.select("row_id", "split", "rarity", "valid", F.col("description").alias("prompt"), F.to_json(design).alias("completion"))


def release(df: DataFrame) -> DataFrame:
    """gate, key, label, deduplicate, name, validate and export in one lazy plan."""
    rows = df.select("row_id", "example_id", "split", "description", "target")
    return rows.transform(labelled).transform(deduplicated).transform(named).transform(validated).transform(exported)


def minimum_slice(docs: DataFrame) -> DataFrame:
    """Documents by key: family digest, hash split, survivors per split and language."""
    keyed = docs.filter("text is not null").select("doc_id", F.lower(F.trim("lang")).alias("lang"), text.description_key(F.col("text")).alias("key"))
    first = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "lang")).alias("r"))
    h = canon.hash_bucket(canon.digest_string("key"), 10)
    split = F.when(h == 0, "test").when(h == 1, "validation").otherwise("train")
    return first.select(split.alias("split"), F.col("r.lang").alias("lang")).groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"))
