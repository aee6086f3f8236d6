import random

import pytest

from sievewright.llm import shingles, spans
from sievewright.llm.spans import SPAN, SharedSpans


def brute(rows):
    at, pairs, cover = {}, set(), {}
    for i, t in rows:
        for s in range(len(t or "") - SPAN + 1):
            at.setdefault(t[s : s + SPAN], set()).add(i)
    for ids in at.values():
        pairs |= {(a, b) for a in ids for b in ids if a < b}
    for i, t in rows:
        end = total = 0
        for s in range(len(t or "") - SPAN + 1):
            if len(at[t[s : s + SPAN]]) > 1:
                total += s + SPAN - max(s, end)
                end = s + SPAN
        if total:
            cover[i] = total
    return pairs, cover


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("abcdefgh é🙂", k=n))
    shared = [text(n) for n in (159, 160, 161, 200, 500, 1500)]
    rows = []
    for i in range(80):
        parts = [text(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, max(0, len(s) - SPAN))
            parts += [s[a : a + rng.randint(150, 400)], text(rng.randint(0, 200))]
        rows.append((i, "".join(parts)))
    return rows + [(100, None), (101, ""), (102, "x" * 159), (103, "y" * 300), (104, "y" * 400), (105, "ab" * 200), (106, "b" + "ab" * 200)]


@pytest.mark.parametrize("few", [64, 2])
def test_pairs_and_coverage_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(spans, "FEW", few)
    rows = corpus(few)
    found = SharedSpans(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    pairs, cover = brute(rows)
    assert {tuple(r) for r in found.pairs().collect()} == pairs
    assert {r["id"]: r["shared_chars"] for r in found.report().collect()} == cover


def test_insertions_move_no_cuts():
    import numpy as np

    rng = random.Random(9)
    t = "".join(rng.choices("abcdefghij ", k=4000))
    cut = lambda s: {s[a - 63 : a + 1] for a in spans.cuts(np.frombuffer(s.encode("utf-32-le"), np.uint32), np.array([0]), np.array([len(s)]))}
    a, b = cut(t), cut(t[:2000] + "inserted" + t[2000:])
    assert len(a & b) > 0.9 * len(a)


def test_long_texts_are_cut_alike_in_blocks(monkeypatch):
    rng = random.Random(4)
    t = ["".join(rng.choices("abcdefghij ", k=30_000))]
    whole = [a.tolist() for a in spans.chunk_rows(t)]
    monkeypatch.setattr(spans, "BLOCK", 5_000)
    parts = [a.tolist() for a in spans.chunk_rows(t)]
    key = lambda x: sorted(zip(x[1], x[2], x[3]))
    assert key(whole) == key(parts)


def test_empty_table_repeats_and_clashing_columns(spark):
    schema = "id long, text string, k0 string, n int, places string"
    assert SharedSpans(spark.createDataFrame([], schema), "id", "text").pairs().count() == 0
    t = "".join(random.Random(1).choices("abcdefgh", k=400))
    df = spark.createDataFrame([(1, t, "a", 1, "x"), (1, t, "a", 1, "x"), (None, t, "a", 1, "x"), (2, "z" + t, "b", 2, "y")], schema)
    found = SharedSpans(df, "id", "text")
    assert [tuple(r) for r in found.pairs().collect()] == [(1, 2)]
    assert {r["id"]: r["shared_chars"] for r in found.report().collect()} == {1: 400, 2: 400}


def test_a_third_of_the_texts_may_be_copies(spark, monkeypatch):
    monkeypatch.setattr(shingles, "PICKED", 3)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    one = text(500)
    rows = [(i, one) for i in range(30)] + [(100 + i, text(300)) for i in range(30)] + [(200, text(50) + one[100:300]), (200, text(400))]
    found = SharedSpans(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert {tuple(r) for r in found.pairs().collect()} == {(a, b) for a in range(30) for b in [*range(a + 1, 30), 200]}
    cover = {r["id"]: r["shared_chars"] for r in found.report().collect()}
    assert cover == {**dict.fromkeys(range(30), 500), 200: 200}
