import json

import pytest

from sievewright.functions import schema
from sievewright.queries import QUERIES

RIGHT = {"type_line": "Land", "oracle_text": "", "rarity": "rare", "colors": ["W", "U"]}
FACE = {"type_line": "Instant", "oracle_text": "x"}
CASES = {
    json.dumps(RIGHT): "",
    json.dumps({"type_line": "\u2014", "oracle_text": "a\\b,}"}): "",
    json.dumps(RIGHT | {"card_faces": [FACE, FACE]}): "",
    json.dumps(RIGHT | {"card_faces": [FACE]}): "/card_faces:minItems",
    json.dumps(RIGHT | {"card_faces": [FACE, {"type_line": 1, "cost": 2}]}): "/card_faces/1/oracle_text:required,/card_faces/1/type_line:type,/card_faces/1:additionalProperties",
    json.dumps(RIGHT | {"rarity": "Rare"}): "/rarity:enum",
    json.dumps(RIGHT | {"colors": ["W", "W", "X"]}): "/colors/2:enum,/colors:uniqueItems",
    "{}": "/oracle_text:required,/type_line:required",
    "[]": ":type",
    "null": ":type",
    '"a"': ":type",
}
BROKEN = ["", "plain text", "{'type_line': 'Land'}", '{"type_line": "Land",}', '{"type_line": "La', "```json\n{}\n```", '{type_line:"Land"}', "{} {}", '{"a": "\\u12"}', "[" * 100_000]


def write(spark, folder, raws):
    spark.createDataFrame(list(enumerate(raws)), "candidate_id long, raw string").write.parquet(f"{folder}/candidates.parquet")


def test_every_output_is_checked(spark, tmp_path):
    write(spark, tmp_path, [*CASES, *BROKEN, None])
    got = {r["candidate_id"]: r for r in QUERIES["j14_schema_checks"](spark, str(tmp_path)).collect()}
    assert len(got) == len(CASES) + len(BROKEN)
    for i, (raw, errors) in enumerate(CASES.items()):
        want = (True, isinstance(json.loads(raw), dict), not errors, errors)
        assert (got[i]["is_json"], got[i]["is_object"], got[i]["schema_valid"], got[i]["schema_errors"]) == want
    for i in range(len(CASES), len(got)):
        assert (got[i]["is_json"], got[i]["is_object"], got[i]["schema_valid"], got[i]["schema_errors"]) == (False, False, False, None)


def test_equality_is_that_of_json():
    unique = schema.validator({"uniqueItems": True})
    assert unique([1, True, "1", None]) == [] and unique([1, 1.0]) == [":uniqueItems"] and unique([{"a": 1, "b": 2}, {"b": 2, "a": 1}]) == [":uniqueItems"]


def test_an_unknown_keyword_is_refused():
    with pytest.raises(ValueError):
        schema.validator({"properties": {"a": {"pattern": "x"}}})


def test_keyed_replies_have_every_label():
    verdict = {"type": "object", "additionalProperties": False, "required": ["pass", "style"], "properties": {"pass": {"type": "boolean"}, "style": {"type": "integer", "enum": [0, 1, 2]}}}
    check = schema.validator(schema.keyed_schema("reviews", ["a", "b"], verdict))
    good = {"pass": True, "style": 2}
    assert check({"reviews": {"a": good, "b": good}}) == [] == check({"reviews": None})
    for bad in ({"a": good}, {"a": good, "b": good, "c": good}, {"a": good, "b": {"pass": 1, "style": 2}}, {"a": good, "b": {"pass": True, "style": True}}):
        assert check({"reviews": bad}) == ["/reviews:anyOf"]
    assert check({}) == ["/reviews:required"] and check({"reviews": None, "more": 1}) == [":additionalProperties"]
