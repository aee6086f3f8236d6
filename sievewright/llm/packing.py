"""Items of varying length in containers of a fixed capacity (problem 7).

Cost-balanced packing: an item of n tokens costs linear * n + quadratic * n^2. Items go in descending order to
the cheapest container that has room. Shards of about equal size are packed apart, each on one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.sources.shared import materialize

#: Containers that one task packs; a shard wastes less than about one of them.
SHARD_CONTAINERS = 1024


def pack(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048, opened_share: float = 0.5) -> np.ndarray:
    """The container of each of the `lengths`, which must be in descending order and at most `capacity`.

    `opened_share` of the containers that the total needs are open at first; an item without room opens another. More from
    the start even out the costs, but spread long items over all of them and leave gaps that no short item is left to fill.
    """
    opened = max(1, int(int(lengths.sum()) * opened_share / capacity))
    room, cost = np.full(opened, capacity, np.int64), np.zeros(opened)
    out = np.empty(len(lengths), np.int64)
    price = linear * lengths + quadratic * lengths.astype(np.float64) ** 2
    for i, n in enumerate(lengths.tolist()):
        open_cost = np.where(room >= n, cost, np.inf)
        k = int(open_cost.argmin())
        if open_cost[k] == np.inf:
            room, cost, k = np.append(room, capacity), np.append(cost, 0.0), len(room)
        out[i] = k
        room[k] -= n
        cost[k] += price[i]
    return out


def pack_items(items: DataFrame, plans: DataFrame, linear: float = 1.0, quadratic: float = 1 / 2048, opened_share: float = 0.5) -> DataFrame:
    """Place every item of each plan: (`plan_id`, `container`, `id`, `piece`, `first_token`, `tokens`).

    `items`: `id`, `source`, `tokens`; `plans`: `plan_id`, `capacity_tokens`, `source` (null: all items, else those
    of that source, ignoring letter case and outer blanks). An item larger than the capacity is cut into full pieces,
    each in its own container, and a rest that is packed like others; no other item is divided. Items without tokens
    take no place and give no row, neither do plans without a positive capacity. Repeated items are placed each.
    """
    named = F.concat(F.lit("="), F.lower(F.trim("source")))
    plan = plans.filter("plan_id is not null and capacity_tokens > 0").select("plan_id", F.col("capacity_tokens").cast("long").alias("capacity"), F.coalesce(named, F.lit("*")).alias("wanted"))
    norm = items.filter("tokens > 0").select("id", F.col("tokens").cast("long").alias("tokens"), F.explode(F.array(F.lit("*"), named)).alias("wanted"))
    placed = norm.join(plan, "wanted").drop("wanted")
    full, rest = F.expr("tokens div capacity"), F.col("tokens") % F.col("capacity")
    count = F.when(F.col("tokens") > F.col("capacity"), full + (rest > 0).cast("long")).otherwise(F.lit(1))
    pieces = placed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).select(
        "plan_id", "capacity", "id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"),
        F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")).alias("n"),
    )
    repeat = F.row_number().over(Window.partitionBy("plan_id", "id", "piece").orderBy("n"))
    whole = pieces.filter("n = capacity").select(
        "plan_id", F.concat_ws("-", F.lit("f"), "id", "piece", repeat).alias("container"), "id", "piece", "first_token", F.col("n").alias("tokens")
    )
    loose = materialize(pieces.filter("n < capacity"), "pieces")
    shards = loose.groupBy("plan_id").agg(F.ceil(F.sum("n") / (F.first("capacity") * SHARD_CONTAINERS)).alias("shards"))
    sharded = loose.join(shards, "plan_id").withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.greatest("shards", F.lit(1))))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "id", "piece"], ascending=[False, True, True], kind="stable")
        made = pack(pdf["n"].to_numpy(), int(pdf["capacity"].iloc[0]), linear, quadratic, opened_share)
        pdf["container"] = [f"s-{s}-{k}" for s, k in zip(pdf["shard"], made)]
        return pdf[["plan_id", "container", "id", "piece", "first_token", "n"]].rename(columns={"n": "tokens"})

    kinds = dict(loose.dtypes)
    schema = f"plan_id {kinds['plan_id']}, container string, id {kinds['id']}, piece long, first_token long, tokens long"
    packed = sharded.select("plan_id", "capacity", "id", "piece", "first_token", "n", "shard").groupBy("plan_id", "shard").applyInPandas(place, schema)
    return packed.unionByName(whole)


def packing_report(packed: DataFrame, plans: DataFrame, linear: float = 1.0, quadratic: float = 1 / 2048) -> DataFrame:
    """Per plan: items, containers, tokens, share of the room used, and the spread of the containers' costs."""
    price = F.lit(linear) * F.col("tokens") + F.lit(quadratic) * F.col("tokens").cast("double") ** 2
    per = packed.groupBy("plan_id", "container").agg(F.sum("tokens").alias("tokens"), F.sum(price).alias("cost"), F.count(F.lit(1)).alias("pieces"))
    room = plans.select("plan_id", "capacity_tokens")
    return per.join(room, "plan_id").groupBy("plan_id").agg(
        F.sum("pieces").alias("pieces"),
        F.count(F.lit(1)).alias("containers"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("tokens") / F.sum("capacity_tokens"), 6).alias("filled"),
        F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("overfull"),
        F.round(F.stddev_pop("cost") / F.avg("cost"), 6).alias("cost_spread"),
    )
