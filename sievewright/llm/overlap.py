"""Records of one split that recur in another (problem 2): a weighted cosine join between two sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.shingles import Batch, Reader, candidate_pairs, classes, expand, of_pairs, prefixes, readable, term_arrays, term_sketch
from sievewright.sources.shared import forget, materialize


def cosine_join(
    rows: DataFrame, terms: Column | None, threshold: float, weights: Column | None = None, words: int = 5, share: float = 0.0, corpus: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Pairs of one row of side 0 and one of side 1 whose term vectors have a cosine of at least `threshold`.

    `rows`: `id` long, `side` 0 or 1, and what `terms` (array of distinct longs) and `weights` (of the same length; all
    one if not given) are computed from; without `terms`, the terms are the runs of `words` words of the column `text`, and
    with `corpus` their weights come from how many rows have them. Inverted lists hold only terms before the tail of each
    vector that neither by its residual norm nor by the other side's maximum weights can reach the threshold (nor `share`
    of its terms, if pairs need that too); products are then exact. Returns the pairs of class representatives (`a`, `b`,
    `common`, `n_a`, `n_b`, `cosine`) and the further members of their classes (`rep`, `id`). Null or empty vectors, and
    weights that are null or not positive, are like nothing. An empty side gives no pairs. Identifiers are taken to be of
    one row each.
    """
    unit = weights is None and not corpus

    def vectors(of: DataFrame) -> DataFrame:
        of = of.filter("id is not null and side is not null")
        if terms is None:
            return of.select("id", "side", "text").filter("text <> ''")
        return of.select("id", "side", terms.alias("terms"), *([] if weights is None else [weights.alias("weights")])).filter("size(terms) > 0")

    every = vectors(rows)
    read: Reader = lambda batch: Batch.of(batch, words)
    if corpus:
        counted, n = rows.sparkSession.sparkContext.broadcast(term_sketch(every, 1, words)), every.count()
        read = lambda batch: b.weighed(counted.value, n) if (b := Batch.of(batch, words)) else None
    kept = prefixes(every, term_sketch(every, 2, read=read), threshold, 2, words, share, unit, read)
    alike = weights is None  # equal sets of terms have equal weights
    reps, members = classes(kept) if alike else (kept, kept.select(F.col("id").alias("rep"), "id").limit(0))
    pairs = candidate_pairs(reps, threshold, 2, unit)
    if alike:
        forget(kept)
    again = vectors(of_pairs(rows, pairs))
    again = materialize(term_arrays(again, read) if terms is None else again, "terms")
    x = again.filter("side = 0").select(F.col("id").alias("a"), F.col("terms").alias("t_a"), *([] if unit else [F.col("weights").alias("w_a")]))
    y = again.filter("side = 1").select(F.col("id").alias("b"), F.col("terms").alias("t_b"), *([] if unit else [F.col("weights").alias("w_b")]))
    both = pairs.join(x, "a").join(y, "b").withColumn("both", F.array_intersect("t_a", "t_b"))
    n_a, n_b = F.size("t_a"), F.size("t_b")
    if unit:
        cosine = F.size("both") / F.sqrt(n_a.cast("double") * n_b)
    else:
        weight = lambda t, w, k: F.greatest(F.coalesce(F.element_at(w, F.array_position(t, k).cast("int")).cast("double"), F.lit(0.0)), F.lit(0.0))
        dot = F.aggregate("both", F.lit(0.0), lambda s, k: s + weight(F.col("t_a"), F.col("w_a"), k) * weight(F.col("t_b"), F.col("w_b"), k))
        square = lambda w: F.aggregate(w, F.lit(0.0), lambda s, v: s + F.pow(F.greatest(F.coalesce(v.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(2)))
        cosine = dot / F.sqrt(square("w_a") * square("w_b"))
    found = both.select("a", "b", F.size("both").alias("common"), n_a.alias("n_a"), n_b.alias("n_b"), cosine.alias("cosine"))
    return found.filter(F.col("cosine") >= threshold - 1e-6), members


def weighted_classes(df: DataFrame, id_col: str, side: Column, text: Column, cosine: float = 0.8, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """Pairs (`a` of side 0, `b` of side 1) of classes of rows whose shingles, weighted by rarity, have a cosine of at least `cosine`.

    A shingle weighs ln(1 + rows / rows that have it), the latter as a count-min sketch of the corpus has them: exact while
    its cells are many, never too few. Also returns the further members of the classes (`rep`, `id`).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), side.cast("int").alias("side"), readable(text).alias("text"))
    pairs, members = cosine_join(rows, None, cosine, words=words, corpus=True)
    return materialize(pairs.select("a", "b"), "close"), members


def like_classes(df: DataFrame, id_col: str, side: Column, text: Column, likeness: float = 0.8, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """Pairs (`a` of side 0, `b` of side 1) of classes of rows with equal shingle sets that have a Jaccard likeness of at least `likeness`.

    A likeness j needs a cosine of at least 2j / (1 + j) of the unit vectors, and j of the terms of either; the exact
    counts of the join then decide. Also returns the further members of the classes (`rep`, `id`).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), side.cast("int").alias("side"), readable(text).alias("text"))
    pairs, members = cosine_join(rows, None, 2 * likeness / (1 + likeness), words=words, share=likeness)
    close = pairs.filter(F.col("common") >= F.lit(likeness - 1e-9) * (F.col("n_a") + F.col("n_b") - F.col("common")))
    return materialize(close.select("a", "b"), "close"), members


def like_texts(df: DataFrame, id_col: str, side: Column, text: Column, likeness: float = 0.8, words: int = 5) -> DataFrame:
    """`like_classes` as pairs (`a` of side 0, `b` of side 1) of all rows."""
    return expand(*like_classes(df, id_col, side, text, likeness, words))


def like_counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(`id`, `links`) of the rows of side 1: how many rows of side 0 each is like, no pair of rows being formed."""
    sizes = members.groupBy("rep").agg((F.count(F.lit(1)) + 1).alias("size"))
    per = pairs.join(sizes.withColumnRenamed("rep", "a"), "a", "left").groupBy("b").agg(F.sum(F.coalesce("size", F.lit(1))).alias("links"))
    return per.select(F.col("b").alias("id"), "links").unionByName(per.join(members, F.col("b") == F.col("rep")).select("id", "links"))


def keyed_rows(df: DataFrame, id_col: str, side: Column, key: Column) -> DataFrame:
    """(`id`, `side`, `key`) of the rows whose key is neither null nor blank."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), side.cast("int").alias("side"), key.alias("key"))
    return rows.filter("id is not null and side is not null and trim(key) <> ''")


def same_key(df: DataFrame, id_col: str, side: Column, key: Column) -> DataFrame:
    """Pairs (`a` of side 0, `b` of side 1) of rows with one key. A null or blank key links nothing."""
    keyed = keyed_rows(df, id_col, side, key)
    x, y = (keyed.filter(F.col("side") == s).select("key", F.col("id").alias(n)) for s, n in ((0, "a"), (1, "b")))
    shared = y.select("key").distinct()  # what the smaller side lacks never meets
    return x.join(shared, "key", "left_semi").join(y, "key").select("a", "b")


def key_counts(df: DataFrame, id_col: str, side: Column, key: Column) -> DataFrame:
    """(`id`, `links`) of the rows of side 1: how many rows of side 0 have their key, counted before the join."""
    keyed = keyed_rows(df, id_col, side, key)
    held = keyed.filter("side = 0").groupBy("key").agg(F.count(F.lit(1)).alias("links"))
    return keyed.filter("side = 1").join(held, "key").select("id", "links")
