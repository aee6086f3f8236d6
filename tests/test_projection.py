from pyspark.sql import functions as F

from sievewright.functions import text
from sievewright.operators import checks, projection

FACE = "struct<name string, type_line string, mana_cost string, colors array<string>, power string, toughness string, oracle_text string>"
CARD = f"id string, name string, layout string, type_line string, colors array<string>, mana_cost string, power string, toughness string, oracle_text string, card_faces array<{FACE}>"


def card(i, name, text_, faces=None, kind="Legendary Creature — Fox", colors=("R",), cost="{1}{R}", power="2", toughness="3", layout="normal"):
    return (i, name, layout, kind, None if colors is None else list(colors), cost, power, toughness, text_, faces)


def face(name, rules, colors=None):
    return (name, "Creature — Fox", "{R}", colors, "1", "1", rules)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), CARD)


def test_names_are_bound_and_bound_back(spark):
    rules = "Ann, Bold attacks (a reminder). Ann rests; Annie stays.\nA token named Ann, Bold wins. Then Ann runs."
    df = frame(spark, card("a", "Ann, Bold", rules))
    row = projection.drafts(df, ["id"]).first()
    assert row["rules"] == "CARDNAME attacks . CARDNAME rests; Annie stays.\nA token named Ann, Bold wins. Then CARDNAME runs."
    both = frame(spark, card("b", "Henrika Dom // Henrika, Seer", None, [face("Henrika Dom", "Transform Henrika Dom into Henrika, Seer. Henrika sings."), face("Henrika, Seer", "Henrika, Seer sees Henrika Dom. Henrika hums.")], layout="transform"))
    made = {r["face"]: r for r in projection.drafts(both.withColumn("names", F.transform("card_faces", lambda f: f["name"])), ["id", "names"]).collect()}
    assert made[0]["rules"] == "Transform CARDNAME into Draft Face 2. CARDNAME sings." and made[0]["draft_name"] == "Draft Face 1"
    assert made[1]["rules"] == "CARDNAME sees Draft Face 1. CARDNAME hums." and made[1]["colors"] == ["R"]
    df = spark.createDataFrame([(made[1]["rules"], "Henrika, Seer", ["Henrika Dom", "Henrika, Seer"])], "r string, n string, a array<string>")
    assert df.select(projection.bound_back(F.col("r"), F.col("n"), F.col("a"))).first()[0] == "Henrika, Seer sees Henrika Dom. Henrika, Seer hums."
    odd = frame(spark, card("c", r"A\E.* $1", r"A\E.* $1 is (unbalanced"), card("d", None, None), card("e", "", ""))
    assert {r["id"]: r["rules"] for r in projection.drafts(odd, ["id"]).collect()} == {"c": "CARDNAME is (unbalanced", "d": "", "e": ""}
    assert projection.drafts(odd.limit(0), ["id"]).count() == 0


def test_families_ignore_numbers_and_tell_faces_apart(spark):
    two = lambda a, b: [face("X", a), face("Y", b)]
    df = frame(
        spark, card("a", "A", "Draw 2 red cards"), card("b", "B", "Draw three  blue cards"), card("c", "C", "Draw cards"), card("d", "D // E", None, two("Draw one", "Gain 1 life"), layout="split"),
        card("e", "F // G", None, two("Draw nine", "Gain 7 life"), layout="split"), card("f", "F // G", None, two("Draw nine", "Lose 7 life"), layout="split"), card("g", "F // G", None, two("Draw nine", "Gain 7 life"), layout="transform"),
    )
    of = {r["id"]: r["f"] for r in df.select("id", projection.family().alias("f")).collect()}
    assert of["a"] == of["b"] and of["d"] == of["e"] and len(set(of.values())) == 5


def test_levels_tell_what_they_state(spark):
    df = frame(spark, card("a", "Ann", "Flying"), card("b", "Bea", "", power="*"), card("c", "Cid", "Run", colors=(), cost="{2}{W/U}{B}"), card("d", "D // E", None, [face("D", "Go"), face("E", None)], layout="split"))
    got = {(r["id_"], r["style"]): r for r in projection.projections(df.withColumnRenamed("id", "oid").withColumn("id_", F.col("oid")), "oid", "v", ["id_"]).collect()}
    assert len(got) == 20 and len({r["id"] for r in got.values()}) == 20
    a = got["a", "minimal"]
    assert a["type_line"] == "Creature — Fox" and a["rules"] == "" and a["specified"] == ["oracle_text", "power", "toughness", "type_line"] and a["proposed"] == ["colors", "mana_cost"] and "colors" in a["omitted"]
    assert got["a", "concept"]["note"] == "midsize" and "design_notes" in got["a", "concept"]["specified"]
    assert got["a", "complete"]["proposed"] == [] and got["a", "complete"]["rules_coverage"] == "all" and got["a", "mechanics"]["specified"] == ["oracle_text", "type_line"]
    b = got["b", "minimal"]
    assert (b["power"], b["toughness"], b["rules_coverage"]) == ("3", "3", "unspecified") and got["b", "complete"]["power"] == "*" and got["b", "complete"]["rules_coverage"] == "explicit_none"
    c, k = got["c", "minimal"], got["c", "concept"]
    assert (c["colors"], c["mana_cost"], c["adjusted"], c["colors_before"]) == (["W", "U", "B"], "{2}{W/U}{B}", "colors", [])
    assert (k["colors"], k["mana_cost"], k["adjusted"], k["cost_before"]) == ([], "{4}", "mana_cost", "{2}{W/U}{B}")
    assert got["c", "complete"]["adjusted"] is None
    d = got["d", "mechanics"]
    assert d["specified"] == sorted(["layout", "type_line", "oracle_text", *(f"card_faces.{i}.{f}" for i in (0, 1) for f in ("name", "type_line", "oracle_text"))])


def test_features_need_keywords_for_ability_words(spark):
    df = spark.createDataFrame([("Raid — Draw a card.\nLore — A tale.", ["Raid", "Flying"])], "t string, k array<string>")
    made = set(df.select(text.features(F.lit(None).cast("string"), F.lit("Creature"), F.col("t"), F.array(F.lit("U")), F.col("k"))).first()[0])
    assert {"keyword:raid", "keyword:flying", "ability_word:raid"} <= made and "ability_word:lore" not in made


def test_wording_rules_in_order(spark):
    rows = [
        ("When it enters the battlefield, “go”.\n-2: Run.", "Ann", "Creature — Fox", 'When it enters, "go".\n−2: Run.', ["enters", "quotes", "loyalty-minus"]),
        ("As long as Ann is renowned, she runs.\n\"\nAs long as Ann is renowned, no.\"", "Ann", "Creature", "As long as this creature is renowned, she runs.\n\"\nAs long as Ann is renowned, no.\"", ["renowned-self"]),
        ("As long as Ann is renowned, she runs.", "Ann", "Artifact", "As long as Ann is renowned, she runs.", []),
        ("Each opponent sacrifices a creature. That player sacrifices a creature you choose.", "Ann", "Instant", "Each opponent sacrifices a creature of their choice. That player sacrifices a creature you choose.", ["sacrifice-choice"]),
        ("The owner of target permanent puts it on the top or bottom of their library.", None, None, "The owner of target permanent puts it on their choice of the top or bottom of their library.", ["owner-choice"]),
        (None, "Ann", "Creature", None, []),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, t string, n string, k string")
    after, rules = text.normalize_wording(F.col("t"), text.WORDING_RULES, F.col("n"), F.col("k"))
    assert [(r[0], r[1]) for r in df.orderBy("i").select(after, rules).collect()] == [r[3:] for r in rows]


def test_first_match_is_corrupted(spark):
    df = spark.createDataFrame([("Flying\nWhen CARDNAME enters, draw a card.\n{T}: Scry 2. {T}: Go.\n+1: Create a token.", "Old Fox")], "t string, n string")
    made = {c["kind"]: c["text"] for c in df.select(text.corruptions(F.col("t"), F.col("n"))).first()[0]}
    assert made["flying_typo"].startswith("Flyng\n") and made["tap_words"].count("{T}") == 1 and "look at the top 2 cards and scry them" in made["scry_grammar"]
    assert made["old_enters_wording"].splitlines()[1] == "When CARDNAME comes into play, draw a card." and "plus 1: Create" in made["loyalty_words"] and "When Old enters" in made["short_self_reference"]
    assert "vigilance_typo" not in made and list(made) == [k for k, *_ in text.CORRUPTIONS if k in made] + ["short_self_reference"]


def test_descriptions_are_checked(spark):
    t = ("Ann", "Artifact Creature — Fox", "{1}{R}", "2", "3", "Flying")
    rows = [
        ("A 2/3 fox artifact for {1}{R}", "complete", t, []),
        ("An artifact fox", "complete", t, ["missing_or_changed_mana_cost:{1}{R}", "missing_or_changed_stats"]),
        ("A {1}{R} 2/3 thing", "complete", t, ["missing_type_word:Artifact", "missing_type_word:Fox"]),
        ("A fox with a mana rock, 2 / 3, {2}", "minimal", ("Ann", "Artifact Creature — Fox", None, None, None, ""), ["detail_level_leaked_exact_stats", "detail_level_leaked_mana_cost"]),
        ("A walker", "complete", ("Ann", "Planeswalker", None, None, None, ""), []),
        (" ", "complete", (None, None, None, None, None, None), ["invalid_description_length"]),
        (None, "complete", t, None),
    ]
    schema = "i int, description string, style string, target struct<name string, type_line string, mana_cost string, power string, toughness string, oracle_text string>"
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], schema)
    assert [r[0] for r in df.orderBy("i").select(checks.description_issues(F.col("description"), F.col("style"))).collect()] == [r[3] for r in rows]


def test_names_leak_unless_they_are_vocabulary(spark):
    rows = [("Make Silver Fox run", "Silver Fox", "Creature — Cat", [], "", True), ("A red dragon", "Red Dragon", "Creature — Dragon", ["R"], "", False), ("Name it Silver Fox", "Silver Fox", "Creature", [], "Create a Silver Fox.", False), ("foxy", "Fox", "Cat", [], "", False), (None, "Silver Fox", "Cat", [], "", False), ("It has regeneration", "Regeneration", "Aura", [], "Regenerate it.", False)]
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "i int, d string, n string, t string, c array<string>, o string")
    c = F.col
    assert [r[0] for r in df.orderBy("i").select(checks.name_leak(c("d"), c("n"), c("t"), c("c"), c("o"))).collect()] == [r[5] for r in rows]


def test_targets_keep_reminders_only_where_they_must(spark):
    rows = [("Fly (high).", "parsed", "parsed", "m", "m", "Fly .", "removed"), ("Fly.", "parsed", "parsed", "m", "m", "Fly.", "absent"), ("Cycle (pay).", "rejected", "parsed", "x", "m", "Cycle (pay).", "retained_for_parser"), ("Fly (high).", "rejected", "rejected", "m", "m", None, "unreadable"), ("Fly (high).", "parsed", "parsed", "x", "m", None, "changed_meaning")]
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "i int, t string, b string, w string, bm string, m string")
    c = F.col
    made, policy = checks.canonical_target(c("t"), c("b"), c("w"), c("bm"), c("m"))
    assert [tuple(r) for r in df.orderBy("i").select(made, policy).collect()] == [r[5:] for r in rows]


def test_vectors_are_pooled_and_nested_strings_mapped(spark):
    df = spark.createDataFrame([(1, [[3.0, 0.0], [3.0, 8.0]]), (2, []), (3, [[0.0, 0.0]])], "i int, v array<array<double>>")
    assert [r[0] for r in df.orderBy("i").select(text.pooled(F.col("v"), 2)).collect()] == [[0.6, 0.8], None, [None, None]]
    df = spark.createDataFrame([(("a", [("b", 1), (None, 2)]),), (None,)], "s struct<x string, y array<struct<z string, n int>>>")
    got = [r[0] for r in df.select(text.map_strings(F.col("s"), df.schema["s"].dataType, F.upper)).collect()]
    assert got[0]["x"] == "A" and [tuple(y) for y in got[0]["y"]] == [("B", 1), (None, 2)] and got[1] is None
