"""Records that share most of their content (problem 3): joined by vertical partitions of the global n-gram order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.shingles import Batch, Ordered, TermSketch, classes, meetings, of_pairs, order_value, prefixes, readable, term_sketch
from sievewright.sources.shared import forget, materialize


def closed_segments(rows: DataFrame, sketch: TermSketch, cosine: float, likeness: float, words: int, fragments: int) -> DataFrame:
    """The terms of each row by fragment of the global order: (`id`, `fragment`, `open`, `closed`).

    `open` are those that the inverted lists hold, `closed` the rest of those that other rows have.
    """
    held = rows.sparkSession.sparkContext.broadcast((sketch, sketch.pivots(fragments)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk, pivots = held.value
        for batch in batches:
            if (b := Batch.of(batch, words)) is None or (o := Ordered.of(b, sk, cosine, 1, likeness)) is None:
                continue
            mine = np.flatnonzero(o.shared)
            row, u, opened = np.repeat(np.arange(len(o.lens)), o.lens)[mine], o.u[mine], o.open[mine]
            fragment = np.searchsorted(pivots, order_value(sk.estimate(u), u), "right")
            starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (fragment[1:] != fragment[:-1])])
            # Open terms come first in the order, so a segment is its open terms and then its closed ones.
            n_open = np.add.reduceat(opened.astype(np.int64), starts)
            bounds = lambda n: pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            sizes = np.diff(np.r_[starts, len(u)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(o.ids[row[starts]], pa.int64()),
                    pa.array(fragment[starts].astype(np.int32)),
                    pa.ListArray.from_arrays(bounds(n_open), pa.array(u[opened].view(np.int64))),
                    pa.ListArray.from_arrays(bounds(sizes - n_open), pa.array(u[~opened].view(np.int64))),
                ],
                names=["id", "fragment", "open", "closed"],
            )

    return rows.mapInArrow(cut, "id long, fragment int, open array<long>, closed array<long>")


def fragment_join(df: DataFrame, id_col: str, text: Column, likeness: float = 0.8, words: int = 5, fragments: int = 8) -> tuple[DataFrame, DataFrame]:
    """Pairs of rows of `df` whose texts' shingle sets have a Jaccard likeness of at least `likeness`.

    The global order of n-grams, rare to frequent, is cut into fragments, and a pair's overlap is counted in each apart.
    In the rare ones, which hold the open terms of a row (a like pair has some in common), the rows are joined by inverted
    lists: each meeting is counted, in part before the shuffle. In the others, where lists are long, the segments of the
    pairs that can still be like are intersected. The partial overlaps are summed per pair. Returns pairs of class
    representatives (`a` < `b`, `common`, `n_a`, `n_b`) and the further members of classes of equal sets (`rep`, `id`).
    Null, empty and too short texts are like nothing, equal texts are one class, an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.lit(0).alias("side"), readable(text).alias("text")).filter("id is not null and text <> ''")
    cosine = 2 * likeness / (1 + likeness)
    sketch = term_sketch(rows, 1, words)
    kept = prefixes(rows, sketch, cosine, 1, words, likeness)
    reps, members = classes(kept)
    met = meetings(reps, cosine, 1, True).groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("common"), F.max(F.col("reach") >= F.col("need")).alias("can"))
    pairs = materialize(met.filter("can").select("a", "b", "n_a", "n_b", "common"), "pairs")
    forget(kept)
    segments = materialize(closed_segments(of_pairs(rows, pairs), sketch, cosine, likeness, words, fragments), "segments")
    x = segments.select(F.col("id").alias("a"), "fragment", F.col("open").alias("o_a"), F.col("closed").alias("c_a"))
    y = segments.select(F.col("id").alias("b"), "fragment", F.col("open").alias("o_b"), F.col("closed").alias("c_b"))
    # Open terms of both have met; what is closed in one of them has not.
    unmet = F.size(F.array_intersect("c_a", F.concat("o_b", "c_b"))) + F.size(F.array_intersect("o_a", "c_b"))
    rest = pairs.select("a", "b", "n_a", "n_b").join(x, "a").join(y, ["b", "fragment"]).select("a", "b", "n_a", "n_b", unmet.cast("long").alias("common"))
    summed = pairs.unionByName(rest.filter("common > 0")).groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    close = summed.filter(F.col("common") >= F.lit(likeness - 1e-9) * (F.col("n_a") + F.col("n_b") - F.col("common")))
    return materialize(close.select("a", "b", "common", "n_a", "n_b"), "close"), members


def within_classes(members: DataFrame) -> DataFrame:
    """All pairs (`a` < `b`) inside classes of equal records."""
    of = members.select("rep", "id").unionByName(members.select("rep", F.col("rep").alias("id")).distinct())
    return of.select("rep", F.col("id").alias("a")).join(of.select("rep", F.col("id").alias("b")), "rep").filter("a < b").select("a", "b")
