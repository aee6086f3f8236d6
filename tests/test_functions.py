import hashlib
import json

from pyspark.sql import functions as F

from sievewright.functions import canon, text

HARD = ["abc", 'a"b', "tab\there", "line\nend", "back\\slash", "a/b", "žluťoučký", "", "emoji 🙂"]


def one(spark, c, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(c.alias("r")).first()["r"]


def sha(value):
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def test_digests_equal_those_of_canonical_json(spark):
    for v in HARD:
        assert one(spark, canon.digest_string("v"), v) == sha(v)
        assert one(spark, canon.digest_list(F.lit("k"), F.col("v")), v) == sha(["k", v])
        assert one(spark, canon.digest(canon.json_object({"b": F.col("v"), "a": F.lit("x")})), v) == sha({"a": "x", "b": v})
    h = sha("abc")
    assert one(spark, canon.hash_bucket(canon.digest_string("v"), 10), "abc") == int(h[:8], 16) % 10


def test_balanced_parentheses(spark):
    bare = lambda v: one(spark, text.without_parentheses(F.col("v")), v)
    assert bare("Flying (It flies (high).)\nHaste") == "Flying\nHaste"
    assert bare("(a") is None and bare("a)") is None and bare(")(") is None
    assert bare("") == "" and bare(None) is None


def test_description_keys_agree_but_for_form(spark):
    key = lambda v: one(spark, text.description_key(F.col("v")), v)
    assert key("A  Giant!") == key("a giant.") == "a giant"
    assert key("+1/+1") == "+1/+1" and key("Straße") == "strasse" and key(None) is None


def test_compatibility_key(spark):
    assert one(spark, text.compatibility_key(F.col("v")), "Ｆｕｌｌ—Width") == "full width"
    assert one(spark, text.compatibility_key(F.col("v")), None) is None


def test_self_reference_keeps_named_clauses_and_longer_words(spark):
    df = spark.createDataFrame([("Ann, Bold attacks. Annie stays. A card named Ann, Bold wins. Ann draws.", "Ann, Bold")], "t string, n string")
    assert df.select(text.bind_names(F.col("t"), F.col("n"))).first()[0] == "CARDNAME attacks. Annie stays. A card named Ann, Bold wins. CARDNAME draws."
    empty = spark.createDataFrame([(None, "a"), ("x", None), ("x", "")], "t string, n string")
    assert [r[0] for r in empty.select(text.bind_names(F.col("t"), F.col("n"))).collect()] == [None, "x", "x"]


def test_family_key_ignores_numbers_symbols_and_colours(spark):
    key = lambda v: one(spark, text.family_key(F.lit("single"), F.col("v")), v)
    assert key("Deal 3 damage to a white creature for {2}{R}.") == key("Deal 5 damage to a green creature for {4}{W}.")
    assert key("Draw two cards.") == key("Draw three cards.") != key("Lose two cards.")


def test_features_of_two_faced_record(spark):
    df = spark.createDataFrame([("transform", "Creature — Human", "-2: Draw a card.", ["U", "W"])], "l string, t string, o string, c array<string>")
    f = set(df.select(text.features(F.col("l"), F.col("t"), F.col("o"), F.col("c"))).first()[0])
    assert {"layout:transform", "type:creature", "color:W", "color:U", "color_bucket:multicolor", "color_combination:WU", "pattern:loyalty_negative"} <= f


def test_corruptions_change_the_first_match_only(spark):
    made = dict(tuple(x) for x in one(spark, text.corruptions(F.col("v")), "+1: Draw a card.\n-2: Draw a card."))
    assert made["loyalty_colon"] == "+1 Draw a card.\n-2: Draw a card."
    assert made["draw_grammar"] == "+1: draws one card.\n-2: Draw a card."
    assert "tap_words" not in made


def test_mana_values(spark):
    value = lambda v: one(spark, text.mana_value(F.col("v")), v)
    assert (value("{2}{W}{W}"), value("{X}{R}"), value("{2/W}{G/U}"), value("")) == (4, 3, 3, 0)


def test_windows_reach_the_end(spark):
    at = lambda n: spark.sql(f"select cast({n} as bigint) as n").select(text.word_windows(F.col("n"))).first()[0]
    assert at(0) is None and at(1) == [0] and at(480) == [0] and at(481) == [0, 448] and at(929) == [0, 448, 896]
