"""Long exact spans that texts share (problem 9), found by content-defined chunks.

A gear rolling hash over the last WINDOW characters is taken at every place; a place is a cut if its hash is the least
of some REACH places in a row. Cuts depend on the characters around them only, so insertions elsewhere move none. Two
texts with SPAN characters in common have two neighbouring cuts and the WINDOW before the first in common
(WINDOW - 1 + 2 * REACH <= SPAN), hence a chunk with the same digest. An exact comparison of the characters around
equal chunks then decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.llm.fragments import within_classes
from sievewright.llm.shingles import Batch, characters, expand, in_set, mix, picking, powers, readable, term_sketch
from sievewright.sources.shared import materialize

WINDOW, SPAN = 64, 160
REACH = (SPAN + 1 - WINDOW) // 2
#: Characters that are hashed at once; their arrays fit a processor's cache.
BLOCK = 65_536
#: Chunks in more places than this are told apart by all spans around them instead of pair by pair.
FEW = 64
#: A second numbering of characters, for digests of 128 bits.
OTHER = np.uint64(0xD6E8FEB86659FD93)


def gear(codes: np.ndarray) -> np.ndarray:
    """The rolling hash after each character: the sum of the characters' gears, each shifted once per step."""
    with np.errstate(over="ignore"):
        g = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        g = (g ^ (g >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        g = (g ^ (g >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = g ^ (g >> np.uint64(31))
        step = 1
        while step < WINDOW:
            h[step:] = h[step:] + (h[:-step] << np.uint64(step))
            step *= 2
    return h


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over a[i : i + width] for each full window."""
    have, out = 1, a
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(a) - width + 1], out[width - have : width - have + len(a) - width + 1]) if have < width else out


def cuts(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cut places in texts laid end to end, text i being codes[begins[i] : ends[i]]."""
    n = len(codes)
    if n < WINDOW + REACH:
        return np.zeros(0, np.int64)
    h = gear(codes)
    least = sliding(h, REACH, np.minimum)
    begin = np.repeat(begins, ends - begins)[: len(least)]
    end = np.repeat(ends, ends - begins)[: len(least)]
    at = np.arange(len(least))
    least = np.where((at - begin >= WINDOW - 1) & (at + REACH <= end), least, np.uint64(0))
    padded = np.r_[np.zeros(REACH - 1, np.uint64), least, np.zeros(n - len(least), np.uint64)]
    return np.flatnonzero((sliding(padded, REACH, np.maximum) == h) & (h > 0))


def blocks(texts: list[str]) -> Iterator[tuple[list[int], list[int], str]]:
    """Texts in blocks: (index of each part, its offset in the text, the parts' characters). Long ones overlap."""
    margin = SPAN + 2 * REACH
    ids, offs, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for off in range(0, max(1, len(t) - margin), BLOCK - margin):
            part = t[off : off + BLOCK]
            if size and size + len(part) > BLOCK:
                yield ids, offs, parts
                ids, offs, parts, size = [], [], [], 0
            ids.append(i)
            offs.append(off)
            parts.append(part)
            size += len(part)
    if ids:
        yield ids, offs, parts


def rolled(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, other: bool = False) -> np.ndarray:
    """Digests of codes[begins[i] : ends[i]], by differences of rolling sums; `other` is a second, independent one."""
    numbers = characters()[1][codes]
    up, down = powers(1 << max(len(codes) - 1, 1).bit_length())
    sums = np.r_[np.uint64(0), np.cumsum((mix(numbers ^ OTHER) if other else numbers) * up[: len(codes)])]
    return mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))


def chunk_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of each text: (index of the text, first cut, last cut, digest)."""
    made, long = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)], False
    for ids, offs, parts in blocks(texts):
        lens = np.array([len(p) for p in parts])
        ends = np.cumsum(lens)
        begins = ends - lens
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = cuts(codes, begins, ends)
        part = np.searchsorted(ends, at, "right")
        one = (part[:-1] == part[1:]) & (np.diff(at) <= REACH)
        a, b, part = at[:-1][one], at[1:][one], part[:-1][one]
        off = np.array(offs, np.int64)[part] - begins[part]
        made.append((np.array(ids, np.int64)[part], a + off, b + off, rolled(codes, a - WINDOW + 1, b + 1)))
        long = long or any(offs)
    who, first, last, digest = map(np.concatenate, zip(*made))
    if long:  # places in the overlap of two blocks
        _, once = np.unique(np.stack([who, first]), axis=1, return_index=True)
        who, first, last, digest = who[once], first[once], last[once], digest[once]
    return who, first, last, digest


def chunk_batch(batch: pa.RecordBatch) -> Batch | None:
    """The distinct chunk digests of each text of a batch (`id`, `text`)."""
    who, _, _, digest = chunk_rows(batch.column("text").to_pylist())
    if not len(who):
        return None
    by = np.lexsort((digest, who))
    who, digest = who[by], digest[by]
    new = np.r_[True, (who[1:] != who[:-1]) | (digest[1:] != digest[:-1])]
    none = np.zeros(0, np.int64)
    return Batch(none, np.zeros(batch.num_rows, np.int64), none, none, who[new], digest[new], np.ones(int(new.sum())))


def common(x: str, y: str) -> int:
    """Length of the longest common beginning."""
    low, high = 0, min(len(x), len(y))
    if x[:high] == y[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if x[:mid] == y[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class SharedSpans:
    """What texts of `df` share: spans of at least SPAN characters (code points, as stored) that occur in two rows.

    Null and shorter texts share nothing; rows that repeat an identifier are one text to each other. Equal texts are one
    class, searched once. A first reading marks in a set of bounded size which chunk digests may occur twice; a second
    sends only those chunks, each with the characters around it that can matter. A span in any number of rows is found:
    chunks in at most FEW places are compared pair by pair, others by the digests of all spans of SPAN characters around
    them, which are grouped with partial aggregation.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str) -> None:
        self.docs = df.select(F.col(id_col).cast("long").alias("id"), readable(F.col(text_col)).alias("text")).filter(f"id is not null and length(text) >= {SPAN}")
        keyed = materialize(self.docs.select("id", F.unhex(F.sha2("text", 256)).alias("key"), F.xxhash64("text").alias("hash"), F.length("text").alias("n_chars")), "texts")
        self.sizes = keyed
        classes = keyed.groupBy("key").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep < last").select("key", "rep")
        members = materialize(keyed.join(classes, "key").filter("id > rep").select("rep", "id", "hash").distinct(), "members")
        self.members = members.select("rep", "id")
        repeats = members.select("id", "hash").distinct()
        firsts = self.docs.withColumn("hash", F.xxhash64("text")).join(picking(repeats), ["id", "hash"], "left_anti").select("id", "text")
        held = df.sparkSession.sparkContext.broadcast(term_sketch(firsts, 1, read=chunk_batch, wide=2).seen[0])

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            twice = held.value
            for batch in batches:
                ids, texts = batch.column("id").to_numpy(), batch.column("text").to_pylist()
                who, first, last, digest = chunk_rows(texts)
                at = np.flatnonzero(in_set(twice, digest))
                for some in np.array_split(at, max(1, len(at) // 50_000)):
                    begin = first[some] - WINDOW + 1
                    need = SPAN - (last[some] + 1 - begin)
                    start = np.maximum(begin - need, 0)
                    around = [texts[w][s:e] for w, s, e in zip(who[some].tolist(), start.tolist(), (last[some] + 1 + need).tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(digest[some].view(np.int64)), pa.array(ids[who[some]], pa.int64()), *(pa.array(x.astype(np.int32)) for x in (start, begin - start, last[some] + 1 - start)), pa.array(around, pa.string())],
                        names=["k", "id", "start", "begin", "end", "around"],
                    )

        self.posts = materialize(firsts.mapInArrow(send, "k long, id long, start int, begin int, end int, around string"), "chunks")
        keys = self.posts.groupBy("k").agg(F.count(F.lit(1)).alias("places"), F.min("id").alias("x"), F.max("id").alias("y")).filter("x < y")
        self.keys = materialize(keys.select("k", "places"), "keys")
        self._few: DataFrame | None = None
        self._many: DataFrame | None = None

    def few(self) -> DataFrame:
        """(`id`, `begin`, `end`, `others`) for chunks in few places: what a row shares around a chunk, and with whom."""
        if self._few is not None:
            return self._few

        def compared(group: list) -> Iterator[tuple]:
            rows = [(p["id"], p["start"] + p["begin"], p["start"] + p["end"], p["around"][: p["begin"]][::-1], p["around"][p["begin"] : p["end"]], p["around"][p["end"] :]) for p in group]
            found: dict[int, list] = {}
            for i, x in enumerate(rows):
                for j, y in enumerate(rows[:i]):
                    if x[0] == y[0] or x[4] != y[4]:
                        continue
                    left, right = common(x[3], y[3]), common(x[5], y[5])
                    if left + right + len(x[4]) >= SPAN:
                        for k, other in ((i, y[0]), (j, x[0])):
                            f = found.setdefault(k, [0, 0, set()])
                            f[0], f[1] = max(f[0], left), max(f[1], right)
                            f[2].add(other)
            for k, (left, right, others) in found.items():
                yield rows[k][0], rows[k][1] - left, rows[k][2] + right, [o for o in others if o > rows[k][0]]

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [r for group in batch.column("group").to_pylist() for r in compared(group)]
                columns = list(zip(*out)) if out else [[]] * 4
                types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "begin", "end", "others"])

        near = self.posts.join(self.keys.filter(F.col("places") <= FEW).select("k"), "k")
        groups = near.groupBy("k").agg(F.collect_list(F.struct("id", "start", "begin", "end", "around")).alias("group")).select("group")  # at most FEW each
        self._few = materialize(groups.mapInArrow(meet, "id long, begin int, end int, others array<long>"), "few")
        return self._few

    def many(self) -> DataFrame:
        """(`d0`, `d1`, `id`, `begin`, `mark`) of every span of SPAN characters around chunks in many places.

        `mark` is the character before a span whose predecessor is here too, else empty.
        """
        if self._many is not None:
            return self._many

        def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    around = part.column("around").to_pylist()
                    lens = np.array([len(t) for t in around])
                    count = np.maximum(lens - SPAN + 1, 0)
                    if not count.sum():
                        continue
                    joined = "".join(around)
                    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
                    row = np.repeat(np.arange(len(lens)), count)
                    inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                    begin = (np.cumsum(lens) - lens)[row] + inside
                    mark = [joined[b - 1] if i else "" for b, i in zip(begin.tolist(), inside.tolist())]
                    digests = (rolled(codes, begin, begin + SPAN, other).view(np.int64) for other in (False, True))
                    ids, start = part.column("id").to_numpy()[row], part.column("start").to_numpy()[row]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, digests), pa.array(ids, pa.int64()), pa.array((start + inside).astype(np.int32)), pa.array(mark, pa.string())], names=["d0", "d1", "id", "begin", "mark"])

        held = self.posts.join(self.keys.filter(F.col("places") > FEW).select("k"), "k").select("id", "start", "around")
        found = held.mapInArrow(spans, "d0 long, d1 long, id long, begin int, mark string")
        self._many = materialize(found.groupBy("d0", "d1", "id", "begin").agg(F.max("mark").alias("mark")), "many")
        return self._many

    def class_pairs(self) -> DataFrame:
        """Pairs (`a` < `b`) of rows, the first of their classes, that share a span."""
        near = self.few().select(F.col("id").alias("a"), F.explode("others").alias("b"))
        # Two rows meet first at a span before which their characters differ, or where the spans kept begin.
        spans = self.many().select("d0", "d1", "id", "mark").distinct()
        useful = spans.groupBy("d0", "d1").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).filter("low = '' or low <> high").select("d0", "d1")
        kept = spans.join(useful, ["d0", "d1"])
        x = kept.select("d0", "d1", F.col("id").alias("a"), F.col("mark").alias("mark_a"))
        y = kept.select("d0", "d1", F.col("id").alias("b"), F.col("mark").alias("mark_b"))
        far = x.join(y, ["d0", "d1"]).filter("a < b and (mark_a <> mark_b or mark_a = '')").select("a", "b")
        return near.unionByName(far).distinct()

    def pairs(self) -> DataFrame:
        """Pairs (`a` < `b`) of all rows that share a span."""
        every = expand(self.class_pairs(), self.members).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return every.unionByName(within_classes(self.members)).distinct()

    def report(self) -> DataFrame:
        """Per row that shares a span: (`id`, `n_chars`, `shared_chars`, `share`), no pair being formed for frequent spans.

        A row whose text another row has too is shared as a whole.
        """
        repeated = self.many().groupBy("d0", "d1").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x < y").select("d0", "d1")
        far = self.many().join(repeated, ["d0", "d1"]).select("id", "begin", (F.col("begin") + SPAN).alias("end"))
        parts = self.few().select("id", "begin", "end").unionByName(far)
        before = Window.partitionBy("id").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
        fresh = F.greatest(F.col("end") - F.greatest("begin", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
        covered = parts.withColumn("fresh", fresh).groupBy("id").agg(F.sum("fresh").alias("covered"))
        whole = self.members.select("id").unionByName(self.members.select(F.col("rep").alias("id"))).distinct().withColumn("whole", F.lit(True))
        size = self.sizes.groupBy("id").agg(F.max("n_chars").cast("long").alias("n_chars"))
        every = size.join(covered, "id", "left").join(whole, "id", "left").withColumn("shared_chars", F.when(F.col("whole"), F.col("n_chars")).otherwise(F.col("covered")))
        return every.filter("shared_chars is not null").select("id", "n_chars", "shared_chars", F.round(F.col("shared_chars") / F.col("n_chars"), 6).alias("share"))
