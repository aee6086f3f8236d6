"""Paired statistics clustered by family (inventory L) and exact vector search (C20, C21, F08).

The random stream of a replicate starts from sha256("seed:replicate"), so results repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.sources.shared import materialize


#: Queries that are sent to the tasks of an index at once, and those multiplied at once.
PIECE, BLOCK = 65_536, 1024


def class_bootstrap(paired: DataFrame, family: str, difference: Column, replicates: int = 5000, seed: int = 43, low: int = 124, high: int = 4874, most: int = 1_000_000) -> DataFrame:
    """Ratio of sums over families drawn with replacement: one row (`families`, `cases`, `estimate`, `lower`, `upper`), in percent points.

    The limits are the sorted replicates at the 0-based places `low` and `high`; an empty table gives no limits. The cost
    does not grow with the families: a replicate depends on its families by their (difference, cases) only. Families alike in both are a class, and how
    often each class is drawn is multinomial: the same law as that of single draws. The classes, at most `most`, go to the
    driver; a replicate's stream starts from sha256("seed:replicate").
    """
    per = paired.groupBy(family).agg(F.sum(difference).cast("double").alias("d"), F.count(F.lit(1)).alias("c"))
    classes = sorted((r["c"], r["d"], r["m"]) for r in per.groupBy("c", "d").agg(F.count(F.lit(1)).alias("m")).limit(most + 1).collect())
    if len(classes) > most:
        raise ValueError(f"more than {most} classes of families")
    spark = paired.sparkSession
    shape = "families long, cases long, estimate double"
    if not classes:
        return spark.createDataFrame([(0, None, None, None, None)], f"{shape}, lower double, upper double")
    c, d, m = (np.array(x) for x in zip(*classes))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            streams = (np.random.default_rng(int(hashlib.sha256(f"{seed}:{b}".encode()).hexdigest(), 16)) for b in pdf["id"])
            drawn = (g.multinomial(m.sum(), m / m.sum()) for g in streams)
            yield pd.DataFrame({"s": [100.0 * (k @ d) / (k @ c) for k in drawn]})

    place = F.array_sort(F.collect_list("s"))
    limits = spark.range(replicates).mapInPandas(draw, "s double").agg(F.round(F.get(place, F.lit(low)), 6).alias("lower"), F.round(F.get(place, F.lit(high)), 6).alias("upper"))
    total = spark.createDataFrame([(int(m.sum()), int(m @ c), round(float(100.0 * (m @ d) / (m @ c)), 6))], shape)
    return total.crossJoin(limits)


def sign_test(gained: Column, lost: Column) -> Column:
    """Exact two-sided sign test: min(1, 2 * sum of C(n, i) / 2^n for i up to the smaller count)."""
    n, k = gained + lost, F.least(gained, lost)
    zero = F.struct(F.exp(-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("total"))
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k.cast("long")), zero,
        lambda s, i: F.struct((s["term"] * (n - i) / (i + 1)).alias("term"), (s["total"] + s["term"]).alias("total")),
        lambda s: s["total"],
    )
    return F.round(F.least(F.lit(1.0), 2 * tail), 9)


def _unit(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """(`id`, `v`) of unit vectors; zero and null vectors are left out."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return df.filter(F.col(vector).isNotNull()).withColumn("_n", norm).filter("_n > 0").select(F.col(ident).cast("long").alias("id"), F.transform(vector, lambda v: v.cast("double") / F.col("_n")).alias("v"))


class Nearest:
    """The k best items of each query among the blocks seen so far; ties go to the smaller item."""

    columns = {"query": "long", "item": "long", "similarity": "double"}

    def __init__(self, asking: np.ndarray, k: int) -> None:
        self.asking, self.k = asking, k
        self.s, self.item = np.full((len(asking), k), -np.inf), np.full((len(asking), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, s: np.ndarray) -> None:
        s = np.where(np.isnan(s), -np.inf, s)
        at = np.argsort(-s, axis=1, kind="stable")[:, : self.k]  # items come in order
        s, item = np.hstack([self.s, np.take_along_axis(s, at, 1)]), np.hstack([self.item, ids[at]])
        by = np.lexsort((item, -s), axis=1)[:, : self.k]
        self.s, self.item = np.take_along_axis(s, by, 1), np.take_along_axis(item, by, 1)

    def rows(self) -> dict:
        row, place = np.nonzero(np.isfinite(self.s))
        return {"query": self.asking[row], "item": self.item[row, place], "similarity": self.s[row, place]}


class Counts:
    """Of each query, over the blocks seen so far: items, those above a similarity, the least and the greatest."""

    columns = {"query": "long", "items": "long", "near": "long", "low": "double", "most": "double"}

    def __init__(self, asking: np.ndarray, above: float) -> None:
        n = len(asking)
        self.asking, self.above, self.items, self.near, self.low, self.most = asking, above, np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf)

    def add(self, ids: np.ndarray, s: np.ndarray) -> None:
        own = np.isnan(s)
        self.items += (~own).sum(axis=1)
        self.near += (s > self.above).sum(axis=1)
        self.low = np.minimum(self.low, np.where(own, np.inf, s).min(axis=1))
        self.most = np.maximum(self.most, np.where(own, -np.inf, s).max(axis=1))

    def rows(self) -> dict:
        some = self.items > 0
        return {"query": self.asking[some], "items": self.items[some], "near": self.near[some], "low": self.low[some], "most": self.most[some]}


def _search(queries: DataFrame, index: DataFrame, query_id: str, item_id: str, vector: str, state: Callable[[np.ndarray], Nearest | Counts], columns: dict[str, str]) -> DataFrame:
    """What `state` has of each query after all vectors of a task of `index`, one set of rows a task; the own similarity is NaN.

    The index stays where it is. Queries are sent to its tasks in pieces of at most PIECE vectors, each multiplied with the
    vectors of a task block by block; a task keeps only the state of a piece. Each piece is one job whose result is written.
    """
    q, x = materialize(_unit(queries, query_id, vector), "queries"), _unit(index, item_id, vector)
    spark, shape = queries.sparkSession, ", ".join(f"{c} {t}" for c, t in columns.items())
    n = -(-q.count() // PIECE)
    piece = F.pmod(F.xxhash64("id"), F.lit(max(n, 1)).cast("long"))
    parts = []
    for i in range(n):
        rows = q.filter(piece == i).toPandas()  # about PIECE vectors
        if rows.empty:
            continue
        held = spark.sparkContext.broadcast((rows["id"].to_numpy(), np.stack(rows["v"].to_numpy())))

        def multiply(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            asking, v = held.value
            seen = [state(asking[a : a + BLOCK]) for a in range(0, len(asking), BLOCK)]
            for pdf in batches:
                pdf = pdf.sort_values("id")
                ids = pdf["id"].to_numpy()
                if not len(ids):
                    continue
                items = np.stack(pdf["v"].to_numpy()).T
                for at, block in zip(range(0, len(asking), BLOCK), seen):
                    s = np.round(v[at : at + BLOCK] @ items, 9)
                    s[asking[at : at + BLOCK, None] == ids[None, :]] = np.nan
                    block.add(ids, s)
            for block in seen:
                yield pd.DataFrame(block.rows())

        parts.append(materialize(x.mapInPandas(multiply, shape), "found"))
    out = spark.createDataFrame([], shape)
    for p in parts:
        out = out.unionByName(p)
    return out


def top_k_similar(queries: DataFrame, index: DataFrame, k: int, query_id: str = "qid", item_id: str = "id", vector: str = "vector") -> DataFrame:
    """Exact cosine top-k of every query against all of `index`: (`query`, `item`, `similarity`, `rank`).

    Each task keeps k per query, and the tasks' winners are merged by a window. Zero and null vectors are like nothing. Ties
    go to the smaller item. A query is not its own neighbour.
    """
    won = _search(queries, index, query_id, item_id, vector, lambda asking: Nearest(asking, k), Nearest.columns)
    return won.selectExpr("query", "item", "similarity", "row_number() over (partition by query order by similarity desc, item) as rank").filter(F.col("rank") <= k)


def similarity_counts(queries: DataFrame, index: DataFrame, above: float, query_id: str = "qid", item_id: str = "id", vector: str = "vector") -> DataFrame:
    """Over all of `index`, not the nearest only: (`query`, `items`, `near`, `low`, `most`).

    `near` counts the similarities greater than `above`. Every task gives one row per query; these are summed. A query that
    has no other item gets no row.
    """
    parts = _search(queries, index, query_id, item_id, vector, lambda asking: Counts(asking, above), Counts.columns)
    return parts.groupBy("query").agg(F.sum("items").alias("items"), F.sum("near").alias("near"), F.min("low").alias("low"), F.max("most").alias("most"))


def reference_similarity(queries: DataFrame, references: DataFrame, query_id: str = "qid", vector: str = "vector") -> DataFrame:
    """(`query`, `to_reference`): the cosine of each query to its own reference, both joined on `query_id`.

    `references` has `query_id` and `vector`. Without a reference, or with a zero or null vector, there is no row.
    """
    q = _unit(queries, query_id, vector)
    r = _unit(references, query_id, vector).withColumnRenamed("v", "w")
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    return q.join(r, "id").select(F.col("id").alias("query"), F.round(dot, 9).alias("to_reference"))


def interleave(first: Column, second: Column, n: int = 3) -> Column:
    """Two ranked arrays merged: two of the first, one of the second, the rest of both; the first `n` distinct."""
    merged = F.concat(F.slice(first, 1, 2), F.slice(second, 1, 1), F.slice(first, 3, 3), F.slice(second, 2, 4))
    return F.slice(F.array_distinct(merged), 1, n)
