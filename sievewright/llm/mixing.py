"""Sources mixed to target shares of tokens (problem 8) by entropy balancing.

Of all document rates that meet the token constraints, those nearest to one in relative entropy are exponential in
the tokens: rate = min(max_repeats, exp(lambda_source * tokens / mean tokens)). The convex dual is separable by source
and solved by guarded Newton steps, whose gradients and curvatures are sums over the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.sources.shared import materialize

#: Documents in a bucket within which copies are rounded.
BUCKET = 2000


class Dual:
    """One multiplier: a bracketed Newton iteration on an increasing function."""

    def __init__(self, goal: float, most: float):
        self.goal, self.at, self.low, self.high = goal, 0.0, -math.inf, math.inf
        self.full = most <= goal * (1 + 1e-9)  # every document as often as it may be
        self.done = self.full

    def step(self, value: float, slope: float, tolerance: float) -> None:
        off = value - self.goal
        if abs(off) <= tolerance * self.goal:
            self.done = True
            return
        if off < 0:
            self.low = self.at
        else:
            self.high = self.at
        at = self.at - off / slope if slope > 0 else math.nan
        if not self.low < at < self.high or abs(at - self.at) > 4:
            if math.isinf(self.low) or math.isinf(self.high):
                at = self.at + (1.0 if off < 0 else -1.0) * max(1.0, abs(self.at))
            else:
                at = (self.low + self.high) / 2
        self.done = at == self.at
        self.at = at


def diffuse(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of the documents of a bucket: rates rounded down or up, so that the tokens so far stay nearest to what is due.

    Documents go from long to short, so what is off in the end is about half of a short document.
    """
    pdf = pdf.sort_values(["tokens", "id"], ascending=[False, True], kind="stable")
    due, copies = 0.0, []
    for rate, n in zip(pdf["rate"].to_numpy(), pdf["tokens"].to_numpy()):
        whole = math.floor(rate + 1e-9)
        due += (rate - whole) * n
        up = rate - whole > 1e-9 and due >= n / 2
        due -= n * up
        copies.append(whole + up)
    return pdf[["mix_id", "source", "id", "tokens"]].assign(copies=np.array(copies, dtype="int64"))


def balance(items: DataFrame, targets: DataFrame, tolerance: float = 1e-6, most_steps: int = 100) -> tuple[DataFrame, DataFrame]:
    """Copies of items for each mix and the shares reached.

    `items`: `id`, `source`, `tokens`; `targets`: `mix_id`, `source`, `target_share`, `max_repeats`. Sources agree ignoring
    letter case and outer blanks. A mix is as large as its scarcest source present allows; sources missing from the
    items get nothing and the others keep their proportions. Items without tokens or source, and sources that a mix
    does not name, are not used. Returns (`mix_id`, `source`, `id`, `tokens`, `copies`) of items used, and per mix and
    named source its target share, documents, copies, most copies of one, tokens and share of all tokens. The driver
    sees one row per target. An error if the dual is not solved to `tolerance` within `most_steps`.
    """
    key = F.lower(F.trim("source"))
    spark = items.sparkSession
    norm = items.filter("tokens > 0").select("id", key.alias("source"), F.col("tokens").cast("long").alias("tokens")).filter("source is not null")
    wanted = targets.filter("target_share > 0 and max_repeats > 0").select("mix_id", key.alias("source"), "target_share", "max_repeats")
    wanted = wanted.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sizes = materialize(norm.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")), "sizes")  # all that the dual needs
    have = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("total"), F.sum("n").alias("docs"))
    rows = wanted.join(have, "source").collect()
    scale: dict = {}
    for r in rows:
        scale[r["mix_id"]] = min(scale.get(r["mix_id"], math.inf), r["max_repeats"] * r["total"] / r["target_share"])
    duals = {(r["mix_id"], r["source"]): Dual(scale[r["mix_id"]] * r["target_share"], r["max_repeats"] * r["total"]) for r in rows}
    mean = {r["source"]: r["total"] / r["docs"] for r in rows}
    cap = {(r["mix_id"], r["source"]): float(r["max_repeats"]) for r in rows}
    schema = f"mix_id {dict(wanted.dtypes)['mix_id']}, source string, at double, cap double, mean double, docs long, full boolean"
    docs = {r["source"]: r["docs"] for r in rows}

    def multipliers(only_open: bool) -> DataFrame:
        made = [(*k, d.at, cap[k], mean[k[1]], docs[k[1]], d.full) for k, d in duals.items() if not (only_open and d.done)]
        return spark.createDataFrame(made, schema)

    x = F.col("tokens") / F.col("mean")
    rate = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.exp(F.least(F.col("at") * x, F.lit(700.0)))))
    for _ in range(most_steps):
        if all(d.done for d in duals.values()):
            break
        terms = sizes.join(F.broadcast(multipliers(True)), "source").withColumn("w", rate)
        mass = F.col("n") * F.col("tokens") * F.col("w")
        for r in terms.groupBy("mix_id", "source").agg(F.sum(mass).alias("value"), F.sum(F.when(F.col("w") < F.col("cap"), mass * x).otherwise(0.0)).alias("slope")).collect():
            duals[r["mix_id"], r["source"]].step(r["value"], r["slope"], tolerance)
    if open_ := sorted(str(k) for k, d in duals.items() if not d.done):
        raise ArithmeticError(f"no solution within {most_steps} steps for {', '.join(open_)}")
    rated = norm.join(F.broadcast(multipliers(False)), "source").withColumn("rate", rate)
    place = F.pmod(F.xxhash64("id", "tokens"), F.ceil(F.col("docs") / BUCKET))
    rated = rated.select("mix_id", "source", "id", "tokens", "rate", place.alias("bucket"))
    kinds = dict(rated.dtypes)
    shape = f"mix_id {kinds['mix_id']}, source string, id {kinds['id']}, tokens long, copies long"
    copied = rated.groupBy("mix_id", "source", "bucket").applyInPandas(diffuse, shape)
    used = copied.filter("copies > 0")
    per = used.groupBy("mix_id", "source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens")
    )
    whole = Window.partitionBy("mix_id")
    report = wanted.join(per, ["mix_id", "source"], "left").select(
        "mix_id", "source", "target_share", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "copies", "most_copies", "mix_tokens"))
    )
    report = report.withColumn("share", F.round(F.try_divide(F.col("mix_tokens"), F.sum("mix_tokens").over(whole)), 6))
    return used, report
