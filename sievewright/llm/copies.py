"""Records that are equal but for form, collapsed into one with a count (problem 1).

Hot canonical keys are found exactly from partial counts; their rows are salted and aggregated on two
levels, all other rows on one. The representative of a group is its smallest identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.sources.shared import materialize

#: Characters that count in a canonical text, as a Java class; all others are dropped.
KEPT = r"\p{L}\p{Nd}{}/*+\-"
#: Between the fields of a canonical key; never kept inside one.
FIELD_END = "\x1f"


def canonical_text(text: Column, kept: str = KEPT) -> Column:
    """Lower case without the characters outside `kept`; null gives the empty text.

    Folding beyond lower case: final sigma equals sigma, sharp s equals double s.
    """
    folded = F.replace(F.translate(F.lower(text), "ς", "σ"), F.lit("ß"), F.lit("ss"))
    return F.coalesce(F.regexp_replace(folded, f"[^{kept}]+", ""), F.lit(""))


def canonical_key(fields: list[Column], kept: str = KEPT) -> Column:
    """256-bit digest of the canonical fields in the given order, whatever order a record has them in."""
    return F.unhex(F.sha2(F.concat_ws(FIELD_END, *(canonical_text(c, kept) for c in fields)), 256))


def copy_groups(keyed: DataFrame, hot_share: float = 1 / 256, salts: int = 32, hot_rows_at_most: int = 1_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Representatives of the rows of `keyed` (`id` long, `key` binary), as (all, hot keys, hot rows' representatives).

    A key is hot if it holds more than `hot_share` of the rows, or more than `hot_rows_at_most`. So there are fewer than
    1 / `hot_share` hot keys and one for each million rows, of 32 bytes each: that bounds what is broadcast. Result rows:
    `key`, `first_id`, `copies`. An empty table gives no rows.
    """
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = keyed.count()
    hot = materialize(counted.filter(F.col("n") > F.lit(min(total * hot_share, hot_rows_at_most))).select("key"), "hot")
    hot_rows = keyed.join(F.broadcast(hot), "key", "left_semi")
    rest = keyed.join(F.broadcast(hot), "key", "left_anti")
    first = [F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")]
    salted = hot_rows.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(*first)
    of_hot = salted.groupBy("key").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))
    return rest.groupBy("key").agg(*first).unionByName(of_hot), hot, of_hot


def collapse_copies(df: DataFrame, id_col: str, fields: list[Column], kept: str = KEPT) -> tuple[DataFrame, DataFrame]:
    """Groups of copies of `df` and the membership of the rows that are not representatives.

    Returns (`first_id`, `copies`) with one row per distinct record, and (`first_id`, `other_id`) with one row
    per further copy. Null, missing and empty fields agree; rows whose fields are all empty are copies of each
    other. Rows without an identifier are left out. Rows that repeat an identifier count as copies but give no
    pair with themselves. Other columns of `df` are not read.
    """
    keyed = materialize(
        df.select(F.col(id_col).cast("long").alias("id"), canonical_key(fields, kept).alias("key")).filter("id is not null"), "copies"
    )
    groups, hot, of_hot = copy_groups(keyed)
    cold_rows = keyed.join(F.broadcast(hot), "key", "left_anti")
    several = groups.filter("copies > 1").join(F.broadcast(hot), "key", "left_anti")
    cold = cold_rows.join(several, "key")
    of_hot_rows = keyed.join(F.broadcast(of_hot), "key")
    members = cold.unionByName(of_hot_rows).filter("id > first_id").select("first_id", F.col("id").alias("other_id"))
    return groups.select("first_id", "copies"), members.distinct()
