import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.llm import fragments, overlap
from sievewright.llm import shingles
from sievewright.llm.shingles import expand, text_terms


def sets(texts, k):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return out


def like(s, a, b, j):
    both = len(s[a] & s[b])
    return bool(both) and both >= j * (len(s[a] | s[b])) - 1e-9


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(3, 40))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, "common start here " * rng.randint(0, 1) + " ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "ONE, two!  three"), (n + 4, "one two three")]


def self_pairs(spark, rows, j, k):
    df = spark.createDataFrame(rows, "id long, text string")
    pairs, members = fragments.fragment_join(df, "id", F.col("text"), j, k)
    far = expand(pairs.select("a", "b"), members).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return {tuple(r) for r in far.unionByName(fragments.within_classes(members)).collect()}


def test_fragment_join_equals_brute_force(spark):
    for seed, j, k in ((1, 0.6, 3), (2, 0.8, 5)):
        rows = corpus(seed)
        s = sets(rows, k)
        want = {(a, b) for a in s for b in s if a < b and like(s, a, b, j)}
        assert want and self_pairs(spark, rows, j, k) == want


def test_split_join_equals_brute_force(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(i, t, i % 3 if i % 3 < 2 else None) for i, t in rows], "row_id long, description string, s int")
    got = {tuple(r) for r in overlap.like_texts(df, "row_id", F.col("s"), F.col("description"), 0.6, 3).select("a", "b").collect()}
    s = sets(rows, 3)
    want = {(a, b) for a in s for b in s if a % 3 == 0 and b % 3 == 1 and like(s, a, b, 0.6)}
    assert want and got == want


def test_weighted_cosine_is_exact(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        terms = rng.sample(range(1, 30), rng.randint(1, 8))
        rows.append((i, i % 2, [t * 0x9E3779B97F4A7C for t in terms], [rng.choice([0.5, 1.0, 3.0]) for _ in terms]))
    rows += [(100, 0, [], []), (101, 1, None, None)]
    df = spark.createDataFrame(rows, "id long, side int, t array<long>, w array<double>")
    pairs, _ = overlap.cosine_join(df, F.col("t"), 0.7, F.col("w"))
    got = {(r["a"], r["b"]): round(r["cosine"], 6) for r in pairs.collect()}

    def cosine(x, y):
        a, b = dict(zip(x[2], x[3])), dict(zip(y[2], y[3]))
        return sum(a[k] * b.get(k, 0) for k in a) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5

    want = {(x[0], y[0]): round(cosine(x, y), 6) for x in rows[:60] for y in rows[:60] if x[1] == 0 and y[1] == 1 and cosine(x, y) >= 0.7}
    assert want and got == want


def test_weights_of_the_corpus_equal_brute_force(spark):
    rows = corpus(11)
    df = spark.createDataFrame([(i, t, i % 2) for i, t in rows], "row_id long, description string, s int")
    pairs, members = overlap.weighted_classes(df, "row_id", F.col("s"), F.col("description"), 0.7, 3)
    got = {tuple(r) for r in expand(pairs, members).collect()}
    s = sets(rows, 3)
    n = sum(bool(t) for _, t in rows)
    places = Counter(t for x in s.values() for t in x)
    weight = {t: math.log1p(n / k) for t, k in places.items()}
    norm = {i: math.sqrt(sum(weight[t] ** 2 for t in x)) for i, x in s.items()}
    cosine = lambda a, b: sum(weight[t] ** 2 for t in s[a] & s[b]) / (norm[a] * norm[b]) if s[a] and s[b] else 0
    want = {(a, b) for a in s for b in s if a % 2 == 0 and b % 2 == 1 and cosine(a, b) >= 0.7 - 1e-6}
    assert want and got == want


def test_a_third_of_the_rows_may_be_copies(spark):
    rows = [(i, "the same text of several words in every copy") for i in range(40)] + [(100 + i, f"text {i} alone w{i} x{i} y{i} z{i}") for i in range(40)]
    got = self_pairs(spark, rows, 0.8, 5)
    assert len(got) == 40 * 39 // 2


def test_empty_tables_sides_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert fragments.fragment_join(empty, "id", F.col("text"))[0].count() == 0
    rows = [(1, "a b c d e f", 0, "x", 5), (2, "a b c d e f", None, "y", 6)]
    df = spark.createDataFrame(rows, "id long, terms string, side int, rep string, n int")
    assert overlap.like_texts(df, "id", F.col("side"), F.col("terms")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", 0, "x", 5), (2, "a b c d e f", 1, "y", 6)], "id long, terms string, side int, rep string, n int")
    assert [tuple(r) for r in overlap.like_texts(df, "id", F.col("side"), F.col("terms")).collect()] == [(1, 2)]


def test_repeated_rows_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, long), (1, long), (2, long + " end"), (3, "short text of five words")]
    assert self_pairs(spark, rows, 0.8, 5) == {(1, 2)}


def test_keys_link_only_where_they_are_set(spark):
    rows = [(1, 0, "k"), (2, 1, "k"), (3, 1, None), (4, 0, None), (5, 0, " "), (6, 1, " "), (7, None, "k"), (8, 0, "k")]
    df = spark.createDataFrame(rows, "id long, side int, key string")
    assert {tuple(r) for r in overlap.same_key(df, "id", F.col("side"), F.col("key")).collect()} == {(1, 2), (8, 2)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "c1", "é", "_", "-", " ", "\n", "ß", "İ", "٣", "x" * 40]), max_size=60), st.sampled_from([7, 1 << 20]))
def test_shingles_count_like_python(parts, piece):
    text, usual, shingles.PIECE = "".join(parts), shingles.PIECE, piece
    try:
        row, u = text_terms([None, text, "", text], 2)
    finally:
        shingles.PIECE = usual
    want = len(sets([(0, text)], 2)[0])
    assert sorted(row.tolist()) == [1] * want + [3] * want and len(set(u.tolist())) == want


def test_long_lists_are_spread(spark, monkeypatch):
    monkeypatch.setattr(shingles, "LIST", 4)
    monkeypatch.setattr(shingles, "FAN", 2)
    monkeypatch.setattr(shingles, "PICKED", 0)
    rows = corpus(7)
    df = spark.createDataFrame([(i, t, i % 2) for i, t in rows], "row_id long, text string, s int").repartition(5)
    s = sets(rows, 3)
    want = {(a, b) for a in s for b in s if a % 2 == 0 and b % 2 == 1 and like(s, a, b, 0.6)}
    assert {tuple(r) for r in overlap.like_texts(df, "row_id", F.col("s"), F.col("text"), 0.6, 3).select("a", "b").collect()} == want
    assert self_pairs(spark, rows, 0.6, 3) == {(a, b) for a in s for b in s if a < b and like(s, a, b, 0.6)}
    counted = {r["id"]: r["links"] for r in overlap.like_counts(*overlap.like_classes(df, "row_id", F.col("s"), F.col("text"), 0.6, 3)).collect()}
    assert counted == {b: sum(y == b for _, y in want) for b in {y for _, y in want}}
