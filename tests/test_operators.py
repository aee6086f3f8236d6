import pytest
from pyspark.sql import functions as F

from sievewright.operators import aggregates, boundary, gates, joins, selection, statistics, windows


def test_missing_cases_stay_in_the_denominator(spark):
    cases = spark.createDataFrame([(str(i),) for i in range(5)], "id string")
    outcomes = spark.createDataFrame([("0", "parsed", True), ("1", "invalid_json", False), ("2", "invalid_schema", False), ("3", "ignored", False)], "id string, status string, accepted boolean")
    kept = joins.keep_cases(cases, outcomes, "id").withColumn("arm", F.lit("x"))
    r = aggregates.evaluation_rollup(kept, ["arm"]).first()
    assert (r["cases"], r["accepted"], r["missing"], r["rate_all"], r["rate_attempted"]) == (5, 1, 1, 0.2, 1.0)
    none = aggregates.evaluation_rollup(kept.filter("status = 'missing'"), ["arm"]).first()
    assert none["rate_attempted"] is None and none["rate_all"] == 0.0


def test_unknown_and_repeated_keys_are_told(spark):
    cases = spark.createDataFrame([("a",)], "id string")
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    assert [r["id"] for r in joins.unknown_keys(rows, cases, "id").collect()] == ["b"]
    assert [(r["id"], r["n"]) for r in joins.repeated_keys(rows, "id").collect()] == [("a", 2)]


def test_overlay_patches_only_what_it_has(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    patches = spark.createDataFrame([(2, "B", None)], "id int, v string, w string")
    got = {r["id"]: (r["v"], r["w"], r["patched"]) for r in joins.overlay(rows, patches, "id", ["v", "w"]).collect()}
    assert got == {1: ("a", "x", False), 2: ("B", "y", True)}


def test_replay_mix_takes_one_per_family(spark):
    rows = spark.createDataFrame([(i, f"f{i % 15}", i % 15 == 3) for i in range(30)], "id int, fam string, walker boolean")
    out = spark.createDataFrame([("f0",), ("f1",)], "fam string")
    got = selection.replay_mix(rows, "fam", F.sha2("fam", 256), F.col("id"), F.col("walker"), 10, out).collect()
    assert len(got) == 10 and len({r["fam"] for r in got}) == 10 and not {"f0", "f1"} & {r["fam"] for r in got}


def test_sign_test_and_bootstrap(spark):
    df = spark.createDataFrame([(0, 4)], "g long, l long")
    assert df.select(statistics.sign_test(F.col("g"), F.col("l"))).first()[0] == 0.125
    paired = spark.createDataFrame([(0, 1), (0, 1), (1, -1), (1, -1)], "family int, d int")
    r = statistics.class_bootstrap(paired, "family", F.col("d"), replicates=400, low=9, high=389).first()
    assert (r["families"], r["cases"], r["estimate"], r["lower"], r["upper"]) == (2, 4, 0.0, -100.0, 100.0)
    assert statistics.class_bootstrap(paired.limit(0), "family", F.col("d"), replicates=10).first()["families"] == 0


def test_nearest_ranks_do_not_interpolate(spark):
    df = spark.createDataFrame([("a", v) for v in [1, 1, 2, 10]] + [("b", 7), ("c", None)], "g string, v int")
    got = {r["g"]: (r["p50"], r["p99"]) for r in aggregates.nearest_ranks(df, ["g"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    assert got == {"a": (1, 2), "b": (7, 7)}


def test_vector_search_is_exact(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 2.0]), (4, [0.0, 0.0]), (5, None)], "id long, vector array<float>")
    got = statistics.top_k_similar(rows.filter("id = 1").withColumnRenamed("id", "qid"), rows, 2).orderBy("rank").collect()
    assert [r["item"] for r in got] == [2, 3]


def test_round_robin_and_priority(spark):
    rows = spark.createDataFrame([(i, "ab"[i > 2]) for i in range(6)], "id int, style string")
    assert sorted(r["id"] for r in windows.round_robin(rows, "style", [F.col("id")], 4).collect()) == [0, 1, 3, 4]
    assert sorted(r["id"] for r in windows.round_robin(rows, "style", [F.col("id")], 3, {"a": 2}).collect()) == [0, 3, 4]


def test_batches_that_fail_are_halved_and_errors_stay_errors(spark):
    def make():
        def call(items):
            if "bad" in items:
                raise RuntimeError("tool")
            return [x.upper() for x in items]

        return call

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c"), (4, None)], "id int, v string").coalesce(1)
    got = {r["id"]: (r["status"], r["result"]) for r in boundary.apply_batches(rows, "id", "v", make).collect()}
    assert got == {1: ("done", "A"), 2: ("infrastructure_error", None), 3: ("done", "C"), 4: ("absent", None)}


def test_cache_evaluates_each_content_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, v string")
    empty = spark.createDataFrame([], "content_hash string, status string, result string")
    make = lambda: lambda items: [x + "!" for x in items]
    got, new = boundary.cached(rows, "id", "v", empty, make, "pin")
    assert sorted((r["id"], r["result"]) for r in got.collect()) == [(1, "a!"), (2, "a!"), (3, "b!")] and new.count() == 2
    again, none = boundary.cached(rows, "id", "v", new, make, "pin")
    assert none.count() == 0 and again.filter("result is not null").count() == 3


def test_line_process_answers_in_order(spark):
    import sys

    code = "import sys,json\nfor l in sys.stdin: print(json.dumps({'n': len(json.loads(l))}), flush=True)"
    call = boundary.line_process([sys.executable, "-c", code])()
    assert call(["ab", "", "xyz"]) == [{"n": 2}, {"n": 0}, {"n": 3}]


def test_preference_pairs_leave_out_disputed_cases(spark):
    rows = spark.createDataFrame([("c", 1, 0.9, True, False, "x"), ("c", 2, 1.0, True, False, "y"), ("c", 3, None, False, True, "z"), ("d", 4, 1.0, True, False, "s"), ("d", 5, 0.0, False, True, "s"), ("e", 6, 1.0, True, False, "t")], "case string, id int, score double, g boolean, b boolean, t string")
    got = selection.preference_pairs(rows, "case", "id", F.col("score"), F.col("g"), F.col("b"), F.col("t")).collect()
    assert [tuple(r) for r in got] == [("c", 2, 3)]


def test_hash_ranks_equal_row_numbers(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None) for i in range(200)] + [(0, None)], "id int, g string").withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    got = sorted((r["g"] or "", r["place"], r["h"]) for r in windows.hash_ranks(rows, ["g"], "h", ["id"], 1).collect())
    want = []
    for g in ("", "a", "b"):
        hs = sorted(r["h"] for r in rows.collect() if (r["g"] or "") == g)
        want += [(g, i + 1, h) for i, h in enumerate(hs)]
    assert got == want


def test_priority_dedup_loses_no_row(spark):
    rows = spark.createDataFrame([(1, "k", 2), (2, "k", 1), (3, None, 1), (4, None, 1), (5, "x", 1)], "id int, k string, p int")
    kept, dropped = windows.priority_dedup(rows, "k", [F.col("p"), F.col("id")], "id")
    assert sorted(r["id"] for r in kept.collect()) == [2, 3, 5] and sorted(r["id"] for r in dropped.collect()) == [1, 4]
