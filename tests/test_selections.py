import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievewright.operators import selection, windows
from sievewright.queries import QUERIES

CARD = "card_no long, oracle_id string, layout string, type_line string, colors array<string>, oracle_text string, card_faces array<struct<type_line string, oracle_text string, colors array<string>>>"


def word(i):
    return "".join("abcdefghij"[int(c)] for c in f"{i:04d}")


def test_every_feature_is_protected(spark, tmp_path):
    rows = []

    def add(*cards):  # the cards of one family
        rows.extend((len(rows) + i, *c) for i, c in enumerate(cards))

    def card(i, kind, text, colors=("U",), faces=None, layout="normal"):
        return (f"o{i}", layout, kind, list(colors), text, faces)

    for i in range(200):
        add(card(i, "Creature — Elf", f"Plain {word(i)}"))
    for i in range(200, 205):  # rare patterns, of which all families stay
        add(card(i, "Creature — Elf", f"Take an extra turn, {word(i)}"))
    add(card(210, "Battle — Siege", "Lone battle", ("B",)))  # the only family of a type and of three colour strata
    add(card(211, "Creature — Elf", None, ("G",), [("Creature — Elf", "One side", ["G"]), ("Conspiracy", "Other side", ["G"])], "transform"))
    add(card(212, "Creature — Elf", None, ("G",), [("Creature — Elf", "Third side", ["G"]), ("Conspiracy", "Fourth side", ["G"])], "transform"))
    for n in range(3):  # three families of six cards each, alike but for numbers
        add(*(card(300 + 10 * n + k, "Artifact", f"Draw {k} of {word(n)}") for k in range(6)))
    for i in range(400, 402):
        add(card(i, "Artifact", f"Small {word(i)}"))
    for i in range(500, 520):  # a card that was delivered with two texts
        add(card(i, "Creature — Elf", f"Twice {word(i)}"), card(i, "Creature — Elf", f"Again {word(i)}"))
    empty = F.lit(None).cast("string")
    whole = lambda f: F.struct(F.lit("").alias("name"), f["type_line"].alias("type_line"), empty.alias("mana_cost"), f["colors"].alias("colors"), empty.alias("power"), empty.alias("toughness"), f["oracle_text"].alias("oracle_text"))
    df = spark.createDataFrame(rows, CARD).withColumns({"name": F.lit(""), "mana_cost": empty, "power": empty, "toughness": empty, "card_faces": F.transform("card_faces", whole)})
    df.write.parquet(f"{tmp_path}/cards.parquet")

    from sievewright.queries.selection import _families_of_rules

    cards, features = {}, {}
    for r in _families_of_rules(spark, str(tmp_path))[1].collect():
        cards.setdefault(r["family"], set()).add(r["card"])
        features.setdefault(r["family"], set()).add(r["feature"])
    out = {r["family"] for r in QUERIES["h03_protected_holdout"](spark, str(tmp_path)).collect()}
    assert len(out) == 20 and out <= cards.keys()
    held = set().union(*(cards[f] for f in out))
    assert not held & set().union(*(cards[f] for f in cards.keys() - out))
    assert not held & {"o210", *(f"o{i}" for i in range(200, 205)), *(f"o{i}" for i in range(300, 340)), *(f"o{i}" for i in range(500, 520))}
    assert len(held & {"o211", "o212"}) == 1 and len(held & {"o400", "o401"}) >= 1
    for f in set().union(*features.values()):
        assert any(f in features[x] for x in features.keys() - out)


def holdout_rows(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        kind, color = rng.choice(["creature", "creature", "artifact", "planeswalker"]), rng.choice("WUBRG")
        feats = {f"type:{kind}", f"color:{color}", f"color_bucket:{color}", f"color_combination:{color}", f"keyword:{rng.randrange(3)}"} | ({f"pattern:{i}"} if i % 50 == 7 else {f"pattern:many{i % 2}"})
        rows.append((f"g{i:03d}", rng.choice([1, 1, 2, 5]), sorted(feats), f"{rng.random():.12f}", rng.random() < 0.1))
    return rows


@pytest.mark.parametrize("chunk", [3, 4096])
def test_a_holdout_protects_by_its_properties(spark, monkeypatch, chunk):
    monkeypatch.setattr(selection, "CHUNK", chunk)
    monkeypatch.setattr(selection, "DEPTH", 2)
    rows = holdout_rows(5)
    df = spark.createDataFrame(rows, "id string, cards int, features array<string>, rank string, stays boolean")
    taken = set(selection.protected_holdout(df, 24))
    assert len(taken) == 24 and taken == set(selection.protected_holdout(df.repartition(7), 24))
    by = {r[0]: r for r in rows}
    assert all(by[t][1] <= 4 and not by[t][4] for t in taken)
    total = Counter(f for r in rows for f in r[2])
    out = Counter(f for t in taken for f in by[t][2])
    for f, n in total.items():
        floor = 1 if f.startswith(("type:", "layout:", "color")) else max(min(n, 10), math.ceil(0.9 * n))
        assert n - out[f] >= floor
        assert out[f] or not f.startswith(("type:", "color:", "color_bucket:"))
    # A group left behind that is before the last one taken had no room, was not movable, or would have been taken.
    for r in rows:
        if r[0] not in taken and r[1] <= 4 and not r[4] and r[3] < min(by[t][3] for t in taken):
            assert any(n - out[f] <= (1 if f.startswith(("type:", "layout:", "color")) else max(min(n, 10), math.ceil(0.9 * n))) for f in r[2] for n in [total[f]])
    with pytest.raises(ValueError):
        selection.protected_holdout(df, 290)
    lone = df.unionByName(spark.createDataFrame([("lone", 1, ["type:plane"], "0", False)], df.schema))
    with pytest.raises(ValueError):
        selection.protected_holdout(lone, 24)
    assert set(selection.protected_holdout(lone, 24, lone_stays=True)) == taken
    late = df.withColumn("rank", F.when(F.array_contains("features", "type:planeswalker"), F.concat(F.lit("9"), "rank")).otherwise(F.col("rank")))
    assert sum("type:planeswalker" in by[t][2] for t in selection.protected_holdout(late, 24)) == 1


def test_a_cover_adds_most_first(spark):
    rows = [("a", ["x"], "3"), ("b", ["x", "y"], "2"), ("c", ["z"], "1"), ("d", [], "0"), ("e", ["x", "y"], "4")]
    df = spark.createDataFrame(rows, "id string, features array<string>, rank string")
    assert selection.covering_pick(df, 3) == ["b", "c", "d"] and selection.covering_pick(df, 1) == ["b"]
    assert selection.covering_pick(df, 9) == ["b", "c", "d", "a", "e"] and selection.covering_pick(df.limit(0), 2) == []


def test_a_panel_balances_styles(spark):
    rng = random.Random(1)
    rows = [(f"g{i % 30}", i, rng.choice("aaab"), f"{rng.random():.9f}") for i in range(150)]
    df = spark.createDataFrame(rows, "group string, id int, style string, rank string")
    taken = selection.balanced_panel(df, 20)
    by = {r[1]: r for r in rows}
    assert len(taken) == 20 == len({by[t][0] for t in taken})
    best = {}
    for r in rows:
        best[r[0]] = min(best.get(r[0], "9"), r[3])
    assert [by[t][0] for t in taken] == sorted(best, key=best.get)[:20]
    assert sum(by[t][2] == "b" for t in taken) >= 8  # a quarter of the rows, nearly half of the panel


def test_a_stratified_pick_covers_fills_its_quota_and_balances(spark):
    rng = random.Random(7)
    rows = [(f"i{i:03d}", rng.choice("abbbcc"), sorted({rng.choice(["type:land", "type:creature", "type:creature"]), f"color_combination:{rng.choice('WUBRGC')}"} | ({"type:planeswalker"} if i % 9 == 0 else set()) | ({f"type:rare{i}"} if i % 40 == 5 else set())), f"{rng.random():.9f}") for i in range(160)]
    df = spark.createDataFrame(rows, "id string, style string, features array<string>, r string").repartition(5)
    by = {r[0]: r for r in rows}
    order = [F.col("r"), F.col("id")]
    for count in (32, 64, 160):
        got = [r["id"] for r in selection.stratified(df, "id", "style", "features", order, count, "type:planeswalker").collect()]
        assert len(set(got)) == count and {f for r in rows for f in r[2]} == {f for i in got for f in by[i][2]}
        assert sum("type:planeswalker" in by[i][2] for i in got) >= count // 16
        styles, left = Counter(by[i][1] for i in got), Counter(r[1] for r in rows if r[0] not in got)
        assert all(styles[s] >= max(styles.values()) - 6 for s in left)
    for count in (5, 161):  # too few for the cover, more than there are
        with pytest.raises(ValueError):
            selection.stratified(df, "id", "style", "features", order, count, "type:planeswalker")


def test_places_by_ranges_are_row_numbers(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), x) for x in rng.sample(range(-50, 10_000), 200)]
    df = spark.createDataFrame(rows, "g string, n long")
    got = {(r["g"], r["n"]): r["place"] for r in windows.range_ranks(df, ["g"], "n", [], parts=7).collect()}
    assert got == {(g, n): sum(1 for h, m in rows if h == g and m <= n) for g, n in rows}
    assert windows.batches(df.limit(0), ["g"], "n", 5).count() == 0


def test_rare_features_are_picked(spark, tmp_path):
    kinds = {3: "Battle", 5: "Conspiracy", 7: "Plane"}
    costs = {11: "{W}{U}{B}{R}{G}", 13: "{B}{R}{G}"}
    rows = [(i, f"e{i}", "train", f"g{i}", "plain" if i % 2 else "broad", (f"{kinds.get(i, 'Planeswalker' if i % 10 == 0 else 'Creature')} — X", costs.get(i, "{G}"))) for i in range(2000)]
    schema = "row_id long, example_id string, split string, source_group_id string, style string, target struct<type_line string, mana_cost string>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/examples.parquet")
    old = {r["row_id"] for r in QUERIES["h06_round_robin"](spark, str(tmp_path)).collect()}
    got = {r["row_id"] for r in QUERIES["h06_stratified_pick"](spark, str(tmp_path)).collect()}
    assert len(got) == 200 and {*kinds, *costs} <= got and not {*kinds, *costs} <= old
    assert sum(i % 10 == 0 for i in got) >= 12
