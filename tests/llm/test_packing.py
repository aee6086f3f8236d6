import numpy as np

from sievewright.llm.packing import pack, pack_items, packing_report


def items(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, tokens long")


def plans(spark, rows):
    return spark.createDataFrame(rows, "plan_id int, capacity_tokens int, source string")


def test_pack_fits_and_balances():
    rng = np.random.default_rng(1)
    n = -np.sort(-rng.integers(1, 400, 3000))
    at = pack(n, 1000)
    load = np.bincount(at, n)
    assert load.max() <= 1000 and load.sum() == n.sum() and len(load) <= -(-n.sum() // 1000) * 1.02


def test_costs_are_evener_than_first_fit_and_evener_still_with_more_open():
    rng = np.random.default_rng(2)
    n = -np.sort(-np.minimum(rng.lognormal(4.5, 0.9, 5000).astype(np.int64) + 1, 2000))
    price = n + n.astype(float) ** 2 / 2048
    spread = lambda at: (c := np.bincount(at, price)).std() / c.mean()
    room, first_fit = [], []
    for x in n.tolist():
        k = next((i for i, r in enumerate(room) if r >= x), len(room))
        if k == len(room):
            room.append(2048)
        room[k] -= x
        first_fit.append(k)
    half, most = pack(n, 2048), pack(n, 2048, opened_share=0.98)
    least = -(-n.sum() // 2048)
    assert spread(most) < spread(half) < spread(np.array(first_fit))
    assert len(np.bincount(half)) <= least * 1.01 + 1 and len(np.bincount(most)) <= least * 1.03 + 1


def test_only_what_is_too_large_is_divided(spark):
    rows = [(1, "A ", 250), (2, "a", 100), (3, "b", 40), (4, None, 60), (5, "a", 0), (6, "a", None), (3, "b", 40), (7, "b", 200), (7, "b", 200)]
    got = pack_items(items(spark, rows), plans(spark, [(1, 100, None), (2, 100, " a"), (3, 0, None), (4, 100, "zz")])).collect()
    one = [r for r in got if r["plan_id"] == 1]
    assert sum(r["tokens"] for r in one) == 250 + 100 + 40 + 60 + 40 + 400
    assert sorted((r["piece"], r["first_token"], r["tokens"]) for r in one if r["id"] == 1) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert all(r["piece"] == 0 for r in one if r["id"] in (2, 3, 4))
    room = {}
    for r in got:
        room[r["plan_id"], r["container"]] = room.get((r["plan_id"], r["container"]), 0) + r["tokens"]
    assert max(room.values()) <= 100
    assert {r["id"] for r in got if r["plan_id"] == 2} == {1, 2} and {r["plan_id"] for r in got} == {1, 2}


def test_report_and_empty(spark):
    p = plans(spark, [(1, 100, None)])
    r = packing_report(pack_items(items(spark, [(i, "a", 50) for i in range(9)]), p), p).first()
    assert (r["containers"], r["tokens"], r["overfull"]) == (5, 450, 0)
    assert pack_items(items(spark, []), p).count() == 0
