import random
import tracemalloc

from pyspark.sql import functions as F

from sievewright.llm.components import component_pairs, components
from sievewright.llm import splits
from sievewright.llm.splits import assign_splits, choose, plan_splits

TARGETS = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(200):03d}", f"n{rng.randrange(200):03d}") for _ in range(150)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("a", None), ("b", "b")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u and v and u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0
    star = spark.createDataFrame([("hub", f"s{i:03d}") for i in range(300)], "u string, v string")
    assert components(star).select("root").distinct().collect()[0][0] == "hub"
    assert component_pairs(components(star.limit(2))).count() == 3


def test_subset_sums_come_as_near_as_they_can(spark):
    rng = random.Random(2)
    for _ in range(40):
        m = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        target = rng.randint(0, sum(s * k for s, k in m.items()))
        sums = {0}
        for s, k in m.items():
            sums = {x + s * j for x in sums for j in range(k + 1)}
        got = choose(dict(m), target)
        assert all(got[s] <= m[s] for s in got)
        total = sum(s * k for s, k in got.items())
        assert total in sums
        first = {s: k * target // max(sum(a * b for a, b in m.items()), 1) for s, k in m.items()}
        left = {0}
        for s, k in m.items():
            left = {x + s * j for x in left for j in range(k - first[s] + 1)}
        base = sum(s * k for s, k in first.items())
        assert abs(total - target) == min(abs(base + x - target) for x in left)
    plan = plan_splits({1: 50, 50: 1}, {"train": 0.8, "test": 0.2})
    assert sum(s * (b - a) for s, n, a, b in plan if n == "test") == 20


def test_large_totals_are_met_in_little_memory(monkeypatch):
    rng = random.Random(6)
    sizes = {rng.randint(2, 900): rng.randint(1, 4) for _ in range(400)} | {1: 30}
    target = sum(s * m for s, m in sizes.items()) // 3
    monkeypatch.setattr(splits, "STEPS", 64)
    got = choose(sizes, target)
    assert sum(s * m for s, m in got.items()) == target and all(got[s] <= sizes[s] for s in got)
    monkeypatch.undo()
    tracemalloc.start()
    sizes = {s: 3 for s in rng.sample(range(1, 20_000), 1000)}
    target = sum(s * m for s, m in sizes.items()) // 10
    got = choose(sizes, target)
    assert sum(s * m for s, m in got.items()) == target
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_what_hangs_together_stays_together(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["G", " g", "g "]) if i % 3 == 0 else f"g{rng.randrange(150)}", f"f{rng.randrange(60)}" if rng.random() < 0.2 else None) for i in range(600)]
    rows += [(600, None, None), (601, " ", ""), (602, None, "f1"), (602, None, "f1")]
    df = spark.createDataFrame(rows, "id long, g string, fam string").withColumns({"node": F.lit("x"), "component": F.lit(1), "n": F.lit(2)})
    got = assign_splits(df, "id", [F.col("g"), F.col("fam")], spark.createDataFrame(TARGETS, "split string, share double")).collect()
    assert len(got) == len(rows)
    of = {r["id"]: r["split"] for r in got}
    seen = {}
    for i, g, f in rows:
        for key in filter(None, [g and g.strip() and "g" + g.strip().lower(), f and "f" + f]):
            assert seen.setdefault(key, of[i]) == of[i]
    leaks = splits.leaking_keys(df, "id", [F.col("g"), F.col("fam")], assign_splits(df, "id", [F.col("g"), F.col("fam")], spark.createDataFrame(TARGETS, "split string, share double")))
    assert {r["leaking"] for r in leaks.collect()} == {0}
    n = sum(s == "test" for s in of.values())
    assert abs(n - 60) <= 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, g string")
    assert assign_splits(df, "id", [F.col("g")], spark.createDataFrame(TARGETS, "split string, share double")).count() == 0
