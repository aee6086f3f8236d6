import json

from pyspark.sql import functions as F

from sievewright.operators import evaluation

JUDGED = "reward double, verdict string, confidence string, style int, n int, parse string, reference string"


def test_rewards_after_a_judgment(spark):
    rows = [
        ((-1.0, "pass", "high", 2, 0, "parsed", "parsed"), ("decided", -1.0)),
        ((None, None, None, None, 0, "parsed", "parsed"), ("judge_abstention", None)),
        ((None, "pass", "medium", 2, 0, "parsed", "parsed"), ("judge_abstention", None)),
        ((None, "uncertain", "high", 2, 0, "parsed", "parsed"), ("judge_abstention", None)),
        ((None, "pass", "high", 2, 1, "parsed", "parsed"), ("judge_inconsistent", None)),
        ((None, "fail", "high", 2, 0, "parser_error", "parsed"), ("intent_failure", -0.6)),
        ((None, "pass", "high", 0, 0, "parsed", "parsed"), ("unusable_rules", -0.5)),
        ((None, "pass", "high", 2, 0, "parser_error", "parsed"), ("parser_infrastructure_failure", None)),
        ((None, "pass", "high", 2, 0, "parsed", "parser_error"), ("parser_infrastructure_failure", None)),
        ((None, "pass", "high", 2, 0, "parsed", "parsed"), ("faithful_candidate", 1.0)),
        ((None, "pass", "high", 1, 0, "rejected", "parsed"), ("faithful_candidate", 0.825)),
        ((None, "pass", "high", 2, 0, "rejected", "rejected"), ("faithful_candidate", 0.95)),
        ((None, "pass", "high", 2, 0, "rejected", None), ("faithful_candidate", 0.95)),
    ]
    df = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(rows)], f"i int, {JUDGED}")
    c = F.col
    gate, reward = evaluation.combine(F.lit("decided"), c("reward"), c("verdict"), c("confidence"), c("style"), c("n"), c("parse"), c("reference"))
    assert [tuple(r) for r in df.orderBy("i").select(gate, reward).collect()] == [w for _, w in rows]


def test_outputs_are_read_and_held_against_what_was_stated(spark):
    design = {"name": "Ash", "type_line": "Creature — Fox", "oracle_text": "Run.", "power": "1", "toughness": " "}
    raws = [json.dumps(design), "{", "[1]", None, json.dumps({"type_line": "Land"}), json.dumps(design | {"rarity": "odd"}), "{'a': 1}", json.dumps(design | {"extra": 1})]
    df = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    got = {r["id"]: r for r in evaluation.read_outputs(df, "id", "raw").collect()}
    assert [got[i]["is_json"] for i in range(8)] == [True, False, True, False, True, True, False, True]
    assert [got[i]["schema_valid"] for i in range(8)] == [True] + [False] * 7
    assert got[4]["schema_errors"] == "/oracle_text:required" and got[5]["schema_errors"] == "/rarity:enum" and got[7]["schema_errors"] == ":additionalProperties"
    want = spark.createDataFrame([(0, "An ash fox, common", ("Ash", "common", "Creature — Cat", None, "3", None, "x"))], "id int, description string, target struct<name string, rarity string, type_line string, mana_cost string, power string, toughness string, oracle_text string>")
    rows = evaluation.read_outputs(df, "id", "raw").join(want, "id")
    assert rows.select(evaluation.violations(evaluation.stated(F.col("description")))).first()[0] == ["explicit_rarity_missing", "missing_toughness"]


def test_a_rollup_counts_missing_cases_without_a_grid(spark):
    cases = spark.createDataFrame([(str(i), "ab"[i % 2]) for i in range(6)], "case_id string, style string")
    good, bad = ("generated", True, True, "parsed", False, False), ("invalid_json", False, False, None, False, True)
    rows = [("x", str(i), *(good if i < 2 else bad)) for i in range(4)] + [("y", "1", *good), ("y", "99", *good)]
    outs = spark.createDataFrame(rows, "arm string, case_id string, status string, is_object boolean, schema_valid boolean, parse string, rewritten boolean, hit_token_limit boolean")
    got = {(r["arm"], r["style"]): (r["cases"], r["accepted"], r["missing"], r["rate_all"], r["rate_attempted"]) for r in evaluation.rollup(cases, outs, [[], ["style"]]).collect()}
    assert got == {("x", None): (6, 2, 2, 0.333333, 1.0), ("x", "a"): (3, 1, 1, 0.333333, 1.0), ("x", "b"): (3, 1, 1, 0.333333, 1.0), ("y", None): (6, 1, 5, 0.166667, 1.0), ("y", "a"): (3, 0, 3, 0.0, None), ("y", "b"): (3, 1, 2, 0.333333, 1.0)}
    assert evaluation.rollup(cases.limit(0), outs, [[], ["style"]]).filter("cases > 0").count() == 0


def test_groups_need_known_and_different_rewards(spark):
    rows = [("a", "faithful_candidate", 1.0), ("a", "intent_failure", -0.6), ("b", "faithful_candidate", 1.0), ("b", "judge_abstention", None), ("c", "intent_failure", -0.6), ("c", "invalid_json", -1.0), ("d", "faithful_candidate", 1.0), ("d", "faithful_candidate", 1.0)]
    got = evaluation.usable_groups(spark.createDataFrame(rows, "g string, gate string, reward double"), "g").collect()
    assert {r["g"]: r["usable"] for r in got} == {"a": True, "b": False, "c": False, "d": False}
