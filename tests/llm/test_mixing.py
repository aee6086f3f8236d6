import numpy as np
import pytest

from sievewright.llm.mixing import balance

TARGETS = "mix_id int, source string, target_share double, max_repeats int"


def test_shares_caps_and_sources(spark):
    rows = [(i, ["big", " BIG", "small"][i % 3] if i % 30 else "small", 20 + i * 7 % 200) for i in range(3000)] + [(9000, None, 50), (9001, "unnamed", 50), (9002, "big", 0), (9003, "big", None)]
    df = spark.createDataFrame(rows, "id long, source string, tokens long")
    targets = spark.createDataFrame([(1, "Big", 0.5, 1), (1, "small", 0.4, 3), (1, "absent", 0.1, 2), (2, "big", 1.0, 1)], TARGETS)
    used, report = balance(df, targets)
    got = {(r["mix_id"], r["source"]): r for r in report.collect()}
    assert got[1, "absent"]["mix_tokens"] == 0 and got[1, "absent"]["share"] == 0
    assert abs(got[1, "big"]["share"] - 0.5 / 0.9) < 0.01 and abs(got[1, "small"]["share"] - 0.4 / 0.9) < 0.01
    assert got[1, "small"]["most_copies"] <= 3 and got[1, "big"]["most_copies"] == 1
    assert got[2, "big"]["copies"] == sum(1 for _, s, t in rows if s and s.strip().lower() == "big" and t)
    assert {r["source"] for r in used.select("source").distinct().collect()} == {"big", "small"}


def test_rates_are_those_of_the_dual(spark):
    rng = np.random.default_rng(3)
    tokens = {"a": rng.integers(20, 900, 6000), "b": rng.integers(20, 900, 3000)}
    rows = [(i, s, int(t)) for s, v in tokens.items() for i, t in enumerate(v, 10_000 * (s == "b"))]
    cap = {"a": 1, "b": 5}
    used, _ = balance(spark.createDataFrame(rows, "id long, source string, tokens long"), spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.5, 5)], TARGETS))
    copies = {r["id"]: r["copies"] for r in used.collect()}
    t = tokens["b"].astype(float)
    goal, low, high = tokens["a"].sum() * cap["a"] / 0.5 * 0.5, -20.0, 20.0
    rates = lambda at: np.minimum(cap["b"], np.exp(at * t / t.mean()))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (t * rates(mid)).sum() < goal else (low, mid)
    assert all(copies.get(i) == 1 for i in range(6000))  # the scarcest source is used up
    got = np.array([copies.get(10_000 + i, 0) for i in range(3000)])
    for lo in range(20, 900, 220):
        some = (t >= lo) & (t < lo + 220)
        assert abs((t * got)[some].sum() / (t * rates(low))[some].sum() - 1) < 0.02
    assert np.abs(got - rates(low)).max() < 1


def test_unsolved_duals_are_errors(spark):
    rows = [(i, "ab"[i % 2], 10 + i % 7) for i in range(100)]
    with pytest.raises(ArithmeticError):
        balance(spark.createDataFrame(rows, "id long, source string, tokens long"), spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.1, 1)], TARGETS), most_steps=1)


def test_empty_tables_give_no_copies(spark):
    df = spark.createDataFrame([], "id long, source string, tokens long")
    used, report = balance(df, spark.createDataFrame([(1, "a", 1.0, 1)], TARGETS))
    assert used.count() == 0 and report.first()["share"] is None
