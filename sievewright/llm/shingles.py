"""Sets of word shingles, and what is counted about their terms over the whole corpus.

A `TermSketch` holds, in a bounded number of bytes, upper bounds for how often a term occurs and how heavy it
is, and which terms occur at all. It only orders and prunes: no bound in it can lose a pair.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.sources.shared import forget, materialize

#: Characters whose words are hashed at once; their arrays fit a processor's cache.
PIECE = 1 << 16
#: Cells of a row of counts and bits of a set of terms: for inputs up to 1 GB, and the most they grow to. These bound what is broadcast.
CELLS, BITS, MOST_CELLS, MOST_BITS = 1 << 19, 1 << 26, 1 << 22, 1 << 29
#: Chunks in which a sketch travels; how many sketches one task merges; most places of a term that one task joins.
CHUNKS, FAN, LIST = 64, 32, 8192
#: Most identifiers that are broadcast (two longs each) to pick rows; more are joined by a shuffle.
PICKED = 1_000_000
SLACK = 1e-6
STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it is a letter or decimal digit, and a scrambled number of its own."""
    inside = np.zeros(0x110000, bool)
    inside[:0x33480] = [unicodedata.category(chr(c))[0] == "L" or unicodedata.category(chr(c)) == "Nd" for c in range(0x33480)]
    return inside, mix((np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * np.uint64(STEP))


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP and its inverse to the powers 0 to n - 1, modulo 2^64."""
    up, down = np.full(n, STEP, np.uint64), np.full(n, pow(STEP, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _pieces(texts: list) -> Iterator[tuple[list[int], list[str]]]:
    """Lower-case texts in groups of about PIECE characters; longer ones are divided after a character outside words."""
    index, parts, size = [], [], 0
    for i, t in enumerate(texts):
        t = t.lower() if t else ""
        while t:
            at = len(t)
            if at > PIECE:
                at = PIECE
                while at and t[at - 1].isalnum():
                    at -= 1
                at = at or len(t)
            if size and size + at > PIECE:
                yield index, parts
                index, parts, size = [], [], 0
            index.append(i)
            parts.append(t[:at])
            size += at
            t = t[at:]
    if index:
        yield index, parts


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(index of its text, hash) of every word in order. A word is a longest run of letters and digits in lower case."""
    inside, numbers = characters()
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for index, parts in _pieces(texts):
        codes = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.flatnonzero(np.diff(np.r_[False, inside[codes], False].view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            continue
        up, down = powers(1 << max(len(codes) - 1, 1).bit_length())
        sums = np.r_[np.uint64(0), np.cumsum(numbers[codes] * up[: len(codes)])]
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts]))
        begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        rows.append(np.array(index, np.int64)[np.searchsorted(begins, starts, "right") - 1])
    return np.concatenate(rows), np.concatenate(hashes)


def text_terms(texts: list, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of `words` consecutive words of each text, by row; shorter and null texts have none."""
    row, h = word_hashes(texts)
    n = len(h) - words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    u = np.zeros(n, np.uint64)
    for k in range(words):
        u = mix(u + h[k : k + n] * np.uint64(STEP))
    whole = row[:n] == row[words - 1 :]
    row, u = row[:n][whole], u[whole]
    by = np.argsort((row.astype(np.uint64) << np.uint64(44)) | (u >> np.uint64(20)))
    r, v = row[by], u[by]
    if ((v[1:] != v[:-1]) & (v[1:] >> np.uint64(20) == v[:-1] >> np.uint64(20)) & (r[1:] == r[:-1])).any():
        by = np.lexsort((u, row))
        r, v = row[by], u[by]
    new = np.r_[np.ones(min(len(v), 1), bool), (v[1:] != v[:-1]) | (r[1:] != r[:-1])]
    return r[new], v[new]


@dataclass
class Batch:
    """Vectors of one Arrow batch, flat: `row` of each term, its hash `u` and its weight `x` in a vector of length 1."""

    ids: np.ndarray
    side: np.ndarray
    lens: np.ndarray
    starts: np.ndarray
    row: np.ndarray
    u: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, words: int) -> "Batch | None":
        """From `text`, or from `terms` and perhaps `weights`; rows without terms are left out."""
        w = None
        if "text" in batch.schema.names:
            row, u = text_terms(batch.column("text").to_pylist(), words)
        else:
            terms = batch.column("terms")
            row = np.repeat(np.arange(len(terms)), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            u = terms.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            if "weights" in batch.schema.names:
                w = np.maximum(np.nan_to_num(batch.column("weights").flatten().to_numpy(zero_copy_only=False).astype(np.float64)), 0)
        if not len(u):
            return None
        lens = np.bincount(row, minlength=batch.num_rows)
        full = np.flatnonzero(lens)
        row, lens = (np.cumsum(lens > 0) - 1)[row], lens[full]
        starts = np.r_[0, np.cumsum(lens)[:-1]]
        w = np.ones(len(u)) if w is None else w
        norm = np.sqrt(np.add.reduceat(w * w, starts))
        return cls(batch.column("id").to_numpy()[full], batch.column("side").to_numpy()[full], lens, starts, row, u, w / np.maximum(norm, 1e-300)[row])


    def weighed(self, sketch: "TermSketch", rows: int) -> "Batch":
        """With weights from the corpus: ln(1 + rows / places) of each term, places as the sketch counts them."""
        w = np.log1p(rows / np.maximum(sketch.estimate(self.u), 1))
        norm = np.sqrt(np.add.reduceat(w * w, self.starts))
        return replace(self, x=w / norm[self.row])


Reader = Callable[[pa.RecordBatch], Batch | None]


@dataclass
class TermSketch:
    """`counts`: two rows of term counts; `heaviest`: per side the largest weight in a cell; `seen`: per side a bit set."""

    counts: np.ndarray
    heaviest: np.ndarray
    seen: list[np.ndarray]
    total: int = 0

    def cells(self, u: np.ndarray) -> np.ndarray:
        return (u & np.uint64(self.counts.shape[1] - 1)).astype(np.int64)

    def estimate(self, u: np.ndarray) -> np.ndarray:
        return np.minimum(self.counts[0][self.cells(u)], self.counts[1][self.cells(u >> np.uint64(20))]).astype(np.int64)

    def spread(self, u: np.ndarray) -> np.ndarray:
        """Over how many tasks the places of a term are spread; what other terms of its cells add is not counted."""
        noise = 2 * self.total // self.counts.shape[1]
        return np.maximum(-(-(self.estimate(u) - noise) // LIST), 1)

    def pivots(self, fragments: int) -> np.ndarray:
        """Order values that cut the global order into fragments of about equal mass."""
        c = np.sort(self.counts[0][self.counts[0] > 0]).astype(np.int64)
        if not len(c):
            return np.zeros(0, np.uint64)
        mass = np.cumsum(c)
        at = np.searchsorted(mass, mass[-1] * np.arange(1, fragments) / fragments)
        level = c[at]
        low, high = np.searchsorted(c, level, "left"), np.searchsorted(c, level, "right")
        inside = (at - low) / np.maximum(high - low, 1)
        return (level.astype(np.uint64) << np.uint64(24)) + (inside * (1 << 24)).astype(np.uint64)


def order_value(estimates: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The global order of terms: rare before frequent, then by hash."""
    return (estimates.astype(np.uint64) << np.uint64(24)) + (u >> np.uint64(40))


def bit_of(u: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(65 - (8 * len(bits)).bit_length())).astype(np.int64)


def in_set(bits: np.ndarray, u: np.ndarray) -> np.ndarray:
    at = bit_of(u, bits)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def add_to_set(bits: np.ndarray, u: np.ndarray, twice: np.ndarray | None) -> None:
    """Set the bits of `u`; with `twice`, also those there that were set before or come twice."""
    at, n = np.unique(bit_of(u, bits), return_counts=True)
    mask = (1 << (at & 7)).astype(np.uint8)
    byte = at >> 3
    if twice is not None:
        again = (n > 1) | (bits[byte] & mask > 0)
        or_into(twice, byte[again], mask[again])
    or_into(bits, byte, mask)


def or_into(bits: np.ndarray, byte: np.ndarray, mask: np.ndarray) -> None:
    if len(byte):
        starts = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        bits[byte[starts]] |= np.bitwise_or.reduceat(mask, starts)


def sketch_size(df: DataFrame) -> tuple[int, int]:
    """(cells, bits) by the size that the planner states for the input, doubling with each doubling beyond 1 GB."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    doublings = max(0, (size >> 30).bit_length())
    return min(CELLS << doublings, MOST_CELLS), min(BITS << doublings, MOST_BITS)


def _pack(arrays: list[np.ndarray]) -> bytes:
    return pa.compress(b"".join(a.tobytes() for a in arrays), "zstd", asbytes=True)


def _unpack(data: bytes, size: tuple[int, int], sides: int, doubled: bool) -> list[np.ndarray]:
    cells, bits = size[0] // CHUNKS, size[1] // 8 // CHUNKS
    shapes = [(np.int64, (2, cells)), (np.float32, (sides, cells))] + [(np.uint8, (bits,))] * (sides + doubled)
    lengths = [int(np.prod(shape)) * np.dtype(kind).itemsize for kind, shape in shapes]
    raw, at, out = pa.decompress(data, sum(lengths), "zstd", asbytes=True), 0, []
    for (kind, shape), n in zip(shapes, lengths):
        out.append(np.frombuffer(raw[at : at + n], kind).reshape(shape).copy())
        at += n
    return out


def _merge(blobs: Iterator[bytes], size: tuple[int, int], sides: int, doubled: bool) -> bytes:
    total: list[np.ndarray] | None = None
    for blob in blobs:
        new = _unpack(blob, size, sides, doubled)
        if total is None:
            total = new
            continue
        total[0] += new[0]
        np.maximum(total[1], new[1], out=total[1])
        if doubled:
            total[3] |= new[3] | (total[2] & new[2])
        for a, b in zip(total[2 : 2 + sides], new[2:]):
            a |= b
    return _pack(total)


def term_sketch(vectors: DataFrame, sides: int, words: int = 5, read: Reader | None = None, wide: int = 1) -> TermSketch:
    """Count the terms of all `vectors` (`id`, `side` 0 or 1, and `text`, or `terms` and perhaps `weights`; or what `read` takes).

    With two sides `seen` has one set per side, with one side the terms that occur in more than one place. Each task
    sends one sketch of bounded size; a task merges FAN of them at most, in as many rounds as that takes. Sets are `wide`
    times as large as usual.
    """
    doubled = sides == 1
    cells, bits = sketch_size(vectors)
    size = cells, bits = cells, min(bits * wide, MOST_BITS)
    read = read or (lambda batch: Batch.of(batch, words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, heaviest = np.zeros((2, cells), np.int64), np.zeros((sides, cells), np.float32)
        sets = [np.zeros(bits // 8, np.uint8) for _ in range(sides + doubled)]
        some = False
        for batch in batches:
            if (b := read(batch)) is None:
                continue
            some = True
            c0 = (b.u & np.uint64(cells - 1)).astype(np.int64)
            counts[0] += np.bincount(c0, minlength=cells)
            counts[1] += np.bincount(((b.u >> np.uint64(20)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
            of_side = b.side[b.row]
            for s in range(sides):
                mine = of_side == s if sides > 1 else slice(None)
                np.maximum.at(heaviest[s], c0[mine], np.nextafter(b.x[mine].astype(np.float32), np.float32(2)))
                add_to_set(sets[s], b.u[mine], sets[1] if doubled else None)
        part, step, span = TaskContext.get().partitionId(), cells // CHUNKS, bits // 8 // CHUNKS
        for j in range(CHUNKS if some else 0):
            at, to = slice(j * step, (j + 1) * step), slice(j * span, (j + 1) * span)
            blob = _pack([counts[:, at], heaviest[:, at], *(s[to] for s in sets)])
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([j], pa.int32()), "part": pa.array([part], pa.int32()), "data": pa.array([blob], pa.binary())})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "part": [pdf["to"].iloc[0]], "data": [_merge(iter(pdf["data"]), size, sides, doubled)]})

    shape = "chunk int, part int, data binary"
    blobs = vectors.mapInArrow(scan, shape)
    while True:
        blobs, before = materialize(blobs.withColumn("to", F.expr(f"part div {FAN}").cast("int")).groupBy("chunk", "to").applyInPandas(merge, shape), "sketch"), blobs
        forget(before)
        if not (blobs.agg(F.max("part")).first()[0] or 0):
            break
    rows = blobs.orderBy("chunk").collect()
    if not rows:
        return TermSketch(np.zeros((2, cells), np.uint32), np.zeros((sides, cells), np.float32), [np.zeros(bits // 8, np.uint8)] * sides)
    parts = [_unpack(r["data"], size, sides, doubled) for r in rows]
    sets = [np.concatenate([p[2 + i] for p in parts]) for i in range(sides + doubled)]
    counts = np.concatenate([p[0] for p in parts], 1)
    total = int(counts[0].sum())
    return TermSketch(np.minimum(counts, (1 << 32) - 1).astype(np.uint32), np.concatenate([p[1] for p in parts], 1), sets[1:] if doubled else sets, total)


@dataclass
class Ordered:
    """The vectors of a batch that can reach the threshold, terms in the global order: `open` ones come before the tail without lists."""

    ids: np.ndarray
    side: np.ndarray
    lens: np.ndarray
    starts: np.ndarray
    row: np.ndarray
    u: np.ndarray
    shared: np.ndarray
    open: np.ndarray
    residual: np.ndarray

    @classmethod
    def of(cls, b: Batch, sk: TermSketch, threshold: float, sides: int, share: float) -> "Ordered | None":
        """A term that the other side lacks adds nothing, so it counts in no bound (`shared` tells the others).

        The tail of a vector, in the global order, from which neither its norm nor its product with the heaviest weights
        reaches the cosine `threshold`, and which has fewer than `share` of the terms, needs no list.
        """
        c0 = sk.cells(b.u)
        member, heavy = np.zeros(len(b.u), bool), np.zeros(len(b.u))
        of_side = b.side[b.row]
        for s in range(sides):
            mine = np.flatnonzero(of_side == s) if sides > 1 else np.arange(len(b.u))
            other = 1 - s if sides > 1 else 0
            member[mine] = in_set(sk.seen[other], b.u[mine])
            heavy[mine] = sk.heaviest[other][c0[mine]]
        x2, most = np.where(member, b.x * b.x, 0), np.where(member, b.x * heavy, 0)
        count = np.add.reduceat(member.astype(np.int64), b.starts)
        reach = np.minimum(np.sqrt(np.add.reduceat(x2, b.starts)), np.add.reduceat(most, b.starts))
        kept = (reach >= threshold - SLACK) & (count >= share * b.lens - SLACK)
        keep = np.flatnonzero(kept)
        if not len(keep):
            return None
        of = kept[b.row]
        row, u, xm, hv, mem = b.row[of], b.u[of], x2[of], most[of], member[of]
        by = np.lexsort((u, order_value(sk.estimate(u), u), row))
        row, u, xm, hv, mem = (a[by] for a in (row, u, xm, hv, mem))
        lens = b.lens[keep]
        ends = np.cumsum(lens)
        left = lambda a: np.repeat(np.r_[0, np.cumsum(a)][ends], lens) - np.r_[0, np.cumsum(a)][:-1]
        residual = np.sqrt(np.maximum(left(xm), 0))
        opened = mem & (np.minimum(residual, left(hv)) >= threshold - SLACK) & (left(mem.astype(np.int64)) >= share * np.repeat(lens, lens) - SLACK)
        return cls(b.ids[keep], b.side[keep], lens, ends - lens, row, u, mem, opened, residual)

    def per_row(self, a: np.ndarray) -> np.ndarray:
        return np.add.reduceat(a.astype(np.int64), self.starts)


VECTOR = "id long, side int, n int, m int, pterms array<long>, pres array<float>, spread array<int>, b0 long, b1 long, f0 long, f1 long"


def prefixes(vectors: DataFrame, sketch: TermSketch, threshold: float, sides: int, words: int = 5, share: float = 0.0, unit: bool = True, read: Reader | None = None) -> DataFrame:
    """The vectors that can reach the cosine `threshold` with another, each with the terms to meet it by.

    `pterms` are the terms before the tail (see `Ordered`), of `n` in all and `m` that others have; `pres` the norm from
    each on (where weights differ), `spread` over how many tasks each is spread (where any is). `b0`, `b1` are parities of
    the terms, `f0`, `f1` a digest of the set.
    """
    held = vectors.sparkSession.sparkContext.broadcast(sketch)
    read = read or (lambda batch: Batch.of(batch, words))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk = held.value
        for batch in batches:
            if (b := read(batch)) is None or (o := Ordered.of(b, sk, threshold, sides, share)) is None:
                continue
            h = o.u * np.uint64(STEP)
            bit = h >> np.uint64(57)
            one = np.uint64(1) << (bit & np.uint64(63))
            parity = lambda m: np.bitwise_xor.reduceat(np.where(m, one, np.uint64(0)), o.starts).view(np.int64)
            f0 = np.add.reduceat((o.u ^ (o.u >> np.uint64(29))) * np.uint64(0x94D049BB133111EB), o.starts).view(np.int64)
            f1 = np.add.reduceat((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9), o.starts).view(np.int64)
            opened = o.per_row(o.open)
            offsets = np.r_[0, np.cumsum(opened)].astype(np.int32)
            spread = sk.spread(o.u[o.open])
            wide = np.zeros(len(opened), bool)
            wide[np.repeat(np.arange(len(opened)), opened)[spread > 1]] = True
            lists = lambda values, some: pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.r_[~some, False]), values)
            every = np.ones(len(opened), bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(o.ids, pa.int64()),
                    pa.array(o.side, pa.int32()),
                    pa.array(o.lens.astype(np.int32)),
                    pa.array(o.per_row(o.shared).astype(np.int32)),
                    lists(pa.array(o.u[o.open].view(np.int64)), every),
                    lists(pa.array(o.residual[o.open].astype(np.float32)), every & (not unit)),
                    lists(pa.array(spread.astype(np.int32)), wide),
                    *(pa.array(a) for a in (parity(bit < 64), parity(bit >= 64), f0, f1)),
                ],
                names=["id", "side", "n", "m", "pterms", "pres", "spread", "b0", "b1", "f0", "f1"],
            )

    return materialize(vectors.mapInArrow(prune, VECTOR), "vectors")


def picking(few: DataFrame) -> DataFrame:
    """A written table of identifiers, to be broadcast if its rows are counted to be at most PICKED."""
    return F.broadcast(few) if few.count() <= PICKED else few


def classes(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collapse equal vectors of a side: (representatives with all columns, (`rep`, `id`) of the other members).

    The smallest identifier represents a class. Groups are aggregated in part before the shuffle, so a third of
    all rows may be of one class. Rows that repeat an identifier with the same vector are one member.
    """
    key = ["side", "n", "f0", "f1"]
    several = kept.groupBy(*key).agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep < last").select(*key, "rep")
    members = materialize(kept.select("id", *key).join(several, key).filter("id > rep").select("rep", "id", "f0").distinct(), "members")
    return kept.join(picking(members.select("id", "f0")), ["id", "f0"], "left_anti"), members.select("rep", "id")


def postings(reps: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Inverted lists of the open terms, as the left and the right side of a join by `term` and `salt`.

    A list that is too long for one task is spread: its left rows over so many salts, its right rows to each of them.
    """
    posts = reps.select("id", "side", *columns, "m", F.posexplode("pterms").alias("pos", "term"), "pres", "spread")
    posts = posts.select("term", "id", "side", *columns, (F.col("m") - F.col("pos")).alias("left"), F.get("pres", F.col("pos")).alias("res"), F.get("spread", F.col("pos")).alias("tasks"))
    if reps.filter("spread is not null").isEmpty():
        once = posts.drop("tasks").withColumn("salt", F.lit(0).cast("long"))
        return once, once
    tasks = F.coalesce("tasks", F.lit(1)).cast("long")
    every = posts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)))
    return posts.withColumn("salt", F.pmod(F.xxhash64("id"), tasks)).drop("tasks"), every.drop("tasks")


def meetings(reps: DataFrame, threshold: float, sides: int, unit: bool) -> DataFrame:
    """(`a`, `b`, `reach`, `need`, `n_a`, `n_b`) for each open term that two vectors share, if their parities allow it.

    Two sides: `a` of side 0, `b` of side 1; one side: `a` < `b`. `reach` bounds what they have in common from the term on:
    terms with `unit` weights, of which a pair needs `need` = threshold * sqrt(n_a * n_b), else the product. The terms of
    only one of two sets are at least as many as their parities differ.
    """
    left, right = postings(reps, ["n", "b0", "b1"])
    keep = ["term", "salt", "id", "n", "left", "b0", "b1"] if unit else ["term", "salt", "id", "n", "res"]
    left = (left.filter("side = 0") if sides > 1 else left).select(*keep)
    right = (right.filter("side = 1") if sides > 1 else right).select("term", "salt", *(F.col(c).alias(f"{c}_r") for c in keep[2:]))
    met = left.join(right, ["term", "salt"])
    if sides == 1:
        met = met.filter("id < id_r")
    if not unit:
        return met.select(F.col("id").alias("a"), F.col("id_r").alias("b"), (F.col("res") * F.col("res_r")).alias("reach"), F.lit(threshold - 1e-4).alias("need"), F.col("n").alias("n_a"), F.col("n_r").alias("n_b"))
    differ = F.bit_count(F.col("b0").bitwiseXOR(F.col("b0_r"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("b1_r")))
    need = threshold * F.sqrt(F.col("n").cast("double") * F.col("n_r")) - 1e-6
    met = met.withColumn("need", need).filter((F.col("n") + F.col("n_r") - differ) / 2 >= F.col("need"))
    return met.select(F.col("id").alias("a"), F.col("id_r").alias("b"), F.least("left", "left_r").alias("reach"), "need", F.col("n").alias("n_a"), F.col("n_r").alias("n_b"))


def candidate_pairs(reps: DataFrame, threshold: float, sides: int, unit: bool) -> DataFrame:
    """Pairs (`a`, `b`) that can still reach the threshold where they meet: all they share comes from their first meeting on."""
    return materialize(meetings(reps, threshold, sides, unit).filter("reach >= need").select("a", "b").distinct(), "pairs")


def of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The `rows` that occur in pairs, whose texts are worth reading again."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    return rows.join(picking(wanted), "id", "left_semi")


def term_arrays(rows: DataFrame, read: Reader) -> DataFrame:
    """(`id`, `side`, `terms`, `weights`) of the rows (`id`, `side`, `text`) that have terms; the weights make a vector of length 1."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (b := read(batch)) is not None:
                at = pa.array(np.r_[b.starts, len(b.u)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (b.u.view(np.int64), b.x)]
                yield pa.RecordBatch.from_arrays([pa.array(b.ids, pa.int64()), pa.array(b.side, pa.int32()), *lists], names=["id", "side", "terms", "weights"])

    return rows.select("id", "side", "text").mapInArrow(shingle, "id long, side int, terms array<long>, weights array<double>")


def readable(text: Column) -> Column:
    """The text with what is no UTF-8 in it replaced."""
    return F.make_valid_utf8(text)


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (`a`, `b`) of representatives as pairs of all members of their classes."""
    more = pairs.join(members, F.col("a") == F.col("rep")).select(F.col("id").alias("a"), "b")
    first = pairs.unionByName(more)
    return first.unionByName(first.join(members, F.col("b") == F.col("rep")).select("a", F.col("id").alias("b")))
