"""Splits that keep records together which share a key (problem 6)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.components import components
from sievewright.sources.shared import materialize

#: A key of more than this share of the rows is joined by a broadcast; there are fewer than one by it.
HOT_SHARE = 1 / 256
#: Steps in which the bitset tells totals apart; larger totals are met in several rounds of finer and finer units.
STEPS = 1 << 22


def plain_key(key: Column) -> Column:
    """A key in lower case without outer blanks; null if nothing is left."""
    return F.nullif(F.lower(F.trim(key)), F.lit(""))


def key_edges(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Edges (`u`, `v`) between the keys of each row; a key is named by its position, so kinds never mix."""
    named = F.filter(F.array(*(F.concat(F.lit(f"{i}:"), plain_key(k)) for i, k in enumerate(keys))), lambda x: x.isNotNull())
    rows = df.select(named.alias("k")).filter("size(k) > 1").distinct()
    return rows.select(F.col("k")[0].alias("u"), F.explode(F.slice("k", 2, len(keys))).alias("v"))


def nearest_subset(items: list[tuple[int, int]], goal: int, above: bool) -> list[int]:
    """Places of the items (size, count; as a whole or not at all) whose weights, size * count, sum nearest to `goal`.

    A subset-sum bitset grows by one item at a time; which item reached a total first is all that is kept to walk back.
    Totals beyond 2 * goal + 1 are never nearest; without `above` neither are those beyond the goal.
    """
    cap = (1 << ((2 * goal + 2) if above else goal + 1)) - 1
    reached, first = 1, np.full(cap.bit_length(), -1, np.int32)
    for i, (s, k) in enumerate(items):
        new = (reached << s * k) & cap & ~reached
        if new:
            bits = np.frombuffer(new.to_bytes((new.bit_length() + 7) // 8, "little"), np.uint8)
            byte = np.flatnonzero(bits)
            at, bit = np.nonzero(np.unpackbits(bits[byte, None], axis=1, bitorder="little"))
            first[byte[at] * 8 + bit] = i
            reached |= new
    below = (reached & ((1 << (goal + 1)) - 1)).bit_length() - 1
    over = reached >> (goal + 1)
    over = goal + 1 + (over & -over).bit_length() - 1 if over else None
    at, used = over if over is not None and over - goal < goal - below else below, []
    while at:
        used.append(int(first[at]))
        at -= items[used[-1]][0] * items[used[-1]][1]
    return used


def choose(multiplicities: dict[int, int], target: int) -> dict[int, int]:
    """How many parts of each size to take so that their total is as near `target` as can be.

    First the same share of each size as of the whole, rounded down; the rest by a subset-sum bitset over the sizes with
    their multiplicities split into powers of two. A rest beyond STEPS is first measured in larger units, rounded so that
    it is never overshot, and what is left of it then in smaller ones down to 1.
    """
    total = sum(s * m for s, m in multiplicities.items())
    if target <= 0 or not total:
        return {}
    taken = {s: m * target // total for s, m in multiplicities.items()}
    while True:
        rest = target - sum(s * m for s, m in taken.items())
        unit = max(1, -(-rest // STEPS))
        whole, items = [], []
        for s, m in sorted(multiplicities.items(), reverse=True):
            spare, k = min(m - taken[s], (2 if unit == 1 else 1) * rest // s), 1
            while spare > 0:
                k = min(k, spare)
                whole.append((s, k))
                items.append((s, k) if unit == 1 else (-(-s * k // unit), 1))
                spare -= k
                k *= 2
        used = nearest_subset(items, rest // unit, unit == 1)
        for i in used:
            taken[whole[i][0]] += whole[i][1]
        if unit == 1 or not used:
            return {s: m for s, m in taken.items() if m}


def plan_splits(multiplicities: dict[int, int], shares: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """(size, split, first rank, rank after the last) for components ranked within their size.

    Splits are filled from the smallest share on; the largest takes what is left. Shares are relative to their sum.
    """
    total, left, at, plan = sum(s * m for s, m in multiplicities.items()), dict(multiplicities), dict.fromkeys(multiplicities, 0), []
    whole = sum(shares.values()) or 1.0
    order = sorted(shares, key=lambda k: (shares[k], k))
    for name in order:
        chosen = choose(left, round(total * shares[name] / whole)) if name != order[-1] else dict(left)
        for s, m in chosen.items():
            plan.append((s, name, at[s], at[s] + m))
            at[s] += m
            left[s] -= m
        left = {s: m for s, m in left.items() if m}
    return plan


def spread_join(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Left join of `rows` with `values` (one row a key), the rows of the few `hot` keys in place by a broadcast, others by a shuffle."""
    keys = hot.select(key)
    few = values.join(F.broadcast(keys), key, "left_semi")
    here = rows.join(F.broadcast(keys), key, "left_semi").join(F.broadcast(few), key, "left")
    return here.unionByName(rows.join(F.broadcast(keys), key, "left_anti").join(values, key, "left"))


def assign_splits(df: DataFrame, id_col: str, keys: list[Column], targets: DataFrame) -> DataFrame:
    """(`id`, `component`, `split`) of every row of `df`; rows that share a key, or a chain of keys, stay together.

    `targets`: `split`, `share`. Null and blank keys link nothing; a row without keys is a component of its own.
    The driver sees only how many components there are of each size: their sizes sum to the rows, so there are at
    most sqrt(2 * rows) different ones. Rows that repeat an identifier are placed each with its keys.
    """
    root = components(key_edges(df, keys))
    named = [F.concat(F.lit(f"{i}:"), plain_key(k)) for i, k in enumerate(keys)]
    own = F.coalesce(*named, F.concat(F.lit("row:"), F.col(id_col).cast("string"), F.lit("")), F.lit("row:"))
    named_rows = materialize(df.select(F.col(id_col).alias("id"), own.alias("node")), "nodes")
    bound = F.lit(named_rows.count() * HOT_SHARE)
    hot = materialize(named_rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bound).select("node"), "hot")
    placed = materialize(spread_join(named_rows, root, "node", hot).select("id", F.coalesce("root", "node").alias("component")), "placed")
    sizes = materialize(placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    counted = {r["n"]: r["m"] for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}
    shares = {r["split"]: float(r["share"]) for r in targets.select("split", "share").collect() if r["split"] is not None and (r["share"] or 0) > 0}
    spark = df.sparkSession
    plan = spark.createDataFrame(plan_splits(counted, shares) or [(0, "", 0, 0)], "n long, split string, low long, high long")
    bucket = F.pmod(F.xxhash64("component"), F.lit(1024))
    cut = sizes.select("component", "n", bucket.alias("bucket"))
    offsets = cut.groupBy("n", "bucket").agg(F.count(F.lit(1)).alias("c")).selectExpr("n", "bucket", "sum(c) over (partition by n order by bucket) - c as before")
    ranked = cut.selectExpr("component", "n", "bucket", "row_number() over (partition by n, bucket order by component) - 1 as r").join(offsets, ["n", "bucket"])
    ranked = ranked.select("component", "n", (F.col("before") + F.col("r")).alias("rank"))
    chosen = ranked.join(F.broadcast(plan), "n").filter("rank >= low and rank < high").select("component", "split")
    return spread_join(placed, materialize(chosen, "chosen"), "component", sizes.filter(F.col("n") > bound)).select("id", "component", "split")


def leaking_keys(df: DataFrame, id_col: str, keys: list[Column], assigned: DataFrame) -> DataFrame:
    """(`split`, `leaking`): per split of `assigned` (`id`, `split`) how many keys also occur in another split; none should."""
    named = F.array(*(F.concat(F.lit(f"{i}:"), plain_key(k)) for i, k in enumerate(keys)))
    rows = df.select(F.col(id_col).alias("id"), F.explode(named).alias("key")).filter("key is not null").join(assigned.select("id", "split"), "id")
    per = rows.groupBy("key", "split").agg(F.lit(1).alias("n"))
    apart = per.groupBy("key").agg(F.min("split").alias("x"), F.max("split").alias("y")).withColumn("leaks", F.col("x") != F.col("y"))
    return per.join(apart, "key").groupBy("split").agg(F.count_if("leaks").alias("leaking"))
