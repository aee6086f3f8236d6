"""Families, splits, quotas and preference pairs (inventory H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import canon, text
from sievewright.operators import projection, selection, windows
from sievewright.queries.cards import card_features, design_coverage
from sievewright.queries.registry import query
from sievewright.queries.windows import GROUP, SHA
from sievewright.sources.shared import materialize
from sievewright.sources.tables import table

def _families_of_rules(spark, d):
    """(`family`, `card`) of every delivery of a card, and (`family`, `card`, `feature`) of all its sides."""
    rows = table(spark, d, "cards").withColumn("card", F.coalesce("oracle_id", F.concat(F.lit("#"), F.col("card_no").cast("string")))).withColumn("family", projection.family())
    rows = materialize(rows.select("family", "card", "layout", "card_faces", *projection.SIDE), "families")  # families are dear and read several times
    return rows.select("family", "card"), card_features(rows, ["family", "card"])


def _holdout_groups(cards, rows):
    """Families with their distinct cards, features and rank, the card that represents them, and whether they share a card with another."""
    distinct = materialize(cards.distinct(), "cards")
    feats = rows.select("family", "feature").distinct().groupBy("family").agg(F.array_sort(F.collect_list("feature")).alias("features"))  # bounded by the kinds
    shared = distinct.groupBy("card").agg(F.min("family").alias("a"), F.max("family").alias("b")).filter("a <> b").select("card")
    stay = distinct.join(shared, "card", "left_semi").select("family").distinct().withColumn("stays", F.lit(True))
    sizes = distinct.groupBy("family").agg(F.count(F.lit(1)).alias("cards"), F.min("card").alias("first"))
    groups = sizes.join(feats, "family").join(stay, "family", "left")
    return materialize(groups.select(F.col("family").alias("id"), "cards", "features", canon.digest_list(F.lit("seed"), F.col("family")).alias("rank"), "stays", "first"), "groups")


@query()
def h03_protected_holdout(spark, d):
    """Families held out so that every feature keeps its families in training and every stratum is on both sides, each with the card that represents it.

    A stratum of one family is in training only. Families that share a card with another stay there too.
    """
    groups = _holdout_groups(*_families_of_rules(spark, d))
    taken = selection.protected_holdout(groups, max(20, groups.count() // 50), lone_stays=True)
    chosen = spark.createDataFrame([(f,) for f in taken], "id string")
    return groups.join(F.broadcast(chosen), "id").select(F.col("id").alias("family"), F.col("first").alias("card"))  # `count` rows


@query()
def h05_covering_pick(spark, d):
    """64 designs, one per family, that cover colours and types with as few as can be, then by rank."""
    d0 = table(spark, d, "custom_cards").filter("family_id is not null and draft.type_line is not null")
    one = d0.groupBy("family_id").agg(F.min_by(F.struct("card_id", design_coverage().alias("features")), "card_id").alias("r"))
    rows = one.select(F.col("r.card_id").alias("id"), "r.features", canon.digest_list(F.lit("cover"), F.col("family_id")).alias("rank"))
    return spark.createDataFrame([(int(x),) for x in selection.covering_pick(rows, 64)], "card_id long")


_REP = f"with r as (select g, style, row_id, h from (select {GROUP} as g, style, row_id, {SHA.format('example_id')} as h, row_number() over (partition by {GROUP} order by {SHA.format('example_id')}, row_id) as k from examples where split = 'train' and example_id is not null and style is not null and source_group_id is not null) where k = 1)"


def _representatives(spark, d):
    rows = table(spark, d, "examples").filter("split = 'train' and example_id is not null and style is not null and source_group_id is not null")
    rows = rows.select(F.lower(F.trim("source_group_id")).alias("g"), "style", "row_id", canon.digest_string("example_id").alias("h"))
    return windows.first_per_group(rows, ["g"], [F.col("h"), F.col("row_id")], ["style", "row_id", "h"])


@query(f"{_REP} select row_id, style from (select *, row_number() over (partition by style order by h, row_id) - 1 as turn from r) order by turn, style, h, row_id limit 200")
def h06_round_robin(spark, d):
    return windows.round_robin(_representatives(spark, d), "style", [F.col("h"), F.col("row_id")], 200).select("row_id", "style")


@query()
def h06_stratified_pick(spark, d):
    """200 training families, or all if there are fewer: every type, colour combination and style, planeswalkers up to a 16th, styles in turn.

    Colours are those of the cost, since a target has none of its own. The cover needs one row a feature, so it is made from
    minima; the rest is in closed form.
    """
    target = table(spark, d, "examples").select("row_id", "target")
    none = F.lit(None).cast("string")
    made = text.features(none, F.col("target.type_line"), none, text.colors_of(F.coalesce("target.mana_cost", F.lit(""))))
    kept = F.filter(made, lambda f: f.startswith("type:") | f.startswith("color_combination:"))
    rows = _representatives(spark, d).join(target, "row_id").select("row_id", "style", "h", F.concat(kept, F.array(F.concat(F.lit("style:"), F.col("style")))).alias("features"))
    return selection.stratified(rows, "row_id", "style", "features", [F.col("h"), F.col("row_id")], min(200, rows.count()), "type:planeswalker").select("row_id", "style")


@query(f"""{_REP}, e as (select r.*, contains(e.target.type_line, 'Planeswalker') as walker, contains(e.target.name, ' // ') as faces from r join examples e on e.row_id = r.row_id),
a as (select row_id from e where walker order by h, row_id limit 16), b as (select row_id from e where faces and row_id not in (select row_id from a) order by h, row_id limit 8),
c as (select row_id from (select row_id, style, h, row_number() over (partition by style order by h, row_id) as turn from e where row_id not in (select row_id from a union all select row_id from b)) order by turn, style, h, row_id limit 128 - (select count(*) from a) - (select count(*) from b))
select row_id, 'walker' as stratum from a union all select row_id, 'faces' from b union all select row_id, 'style' from c""")
def h07_development_panel(spark, d):
    flags = table(spark, d, "examples").select("row_id", F.contains("target.type_line", F.lit("Planeswalker")).alias("walker"), F.contains("target.name", F.lit(" // ")).alias("faces"))
    e = _representatives(spark, d).join(flags, "row_id")
    a = e.filter("walker").orderBy("h", "row_id").limit(16)
    b = e.filter("faces").join(a.select("row_id"), "row_id", "left_anti").orderBy("h", "row_id").limit(8)
    taken = a.select("row_id").unionByName(b.select("row_id"))
    n = 128 - taken.count()
    c = windows.round_robin(e.join(taken, "row_id", "left_anti"), "style", [F.col("h"), F.col("row_id")], n)
    return a.select("row_id", F.lit("walker").alias("stratum")).unionByName(b.select("row_id", F.lit("faces").alias("stratum"))).unionByName(c.select("row_id", F.lit("style").alias("stratum")))


@query("""with x as (select distinct family_id from examples where split = 'test' and family_id is not null),
f as (select family_id, min(card_id) as card_id from custom_cards where family_id is not null and family_id not in (select family_id from x) group by 1),
r as (select f.family_id, f.card_id, sha256('["replay", ' || to_json(f.family_id)::varchar || ']') as rank, contains(c.draft.type_line, 'Planeswalker') as priority from f join custom_cards c on c.card_id = f.card_id),
h as (select card_id, 'priority' as stratum from r where priority order by rank limit 10), o as (select card_id, 'rest' as stratum from r where not priority order by rank limit 90) select * from h union all select * from o""")
def h09_replay_mix(spark, d):
    excluded = table(spark, d, "examples").filter("split = 'test' and family_id is not null")
    rank = canon.digest_list(F.lit("replay"), F.col("family_id"))
    mix = selection.replay_mix(table(spark, d, "custom_cards"), "family_id", rank, F.col("card_id"), F.contains("draft.type_line", F.lit("Planeswalker")), 100, excluded)
    return mix.select(F.col("row").alias("card_id"), "stratum")


@query("""with h as (select row_id, ('0x' || substr(sha256('["augment", ' || to_json(example_id)::varchar || ']'), 1, 8))::bigint as n from examples where example_id is not null)
select row_id, cast(floor(n / 5) as bigint) % 8 as payload from h where n % 5 = 0""".replace("cast(floor(n / 5) as bigint)", "(n // 5)"))
def h11_stable_augment(spark, d):
    h = canon.hash_number(canon.digest_list(F.lit("augment"), F.col("example_id")))
    rows = table(spark, d, "examples").filter("example_id is not null").select("row_id", h.alias("n"))
    return rows.filter("n % 5 = 0").selectExpr("row_id", "(n div 5) % 8 as payload")


_PAIR = "with r as (select case_id, candidate_id as id, -coalesce(output_tokens, 0) as score, not coalesce(hit_token_limit, true) and raw <> '' as good, coalesce(hit_token_limit, false) as bad, sha256(coalesce(raw, '')) as content from candidates where case_id is not null), dis as (select case_id from r group by case_id, content having bool_or(good) and bool_or(bad)), k as (select * from r where case_id not in (select case_id from dis))"


@query(f"""{_PAIR}, g as (select case_id, id, content from (select *, row_number() over (partition by case_id order by score desc, id) as n from k where good) where n = 1), b as (select case_id, id, content from (select *, row_number() over (partition by case_id order by id) as n from k where bad) where n = 1)
select g.case_id as "case", g.id as chosen, b.id as rejected from g join b on g.case_id = b.case_id where g.content <> b.content""")
def h16_preference_pairs(spark, d):
    rows = table(spark, d, "candidates").filter("case_id is not null")
    good = ~F.coalesce("hit_token_limit", F.lit(True)) & (F.coalesce("raw", F.lit("")) != "")
    return selection.preference_pairs(rows, "case_id", "candidate_id", -F.coalesce("output_tokens", F.lit(0)), good, F.col("hit_token_limit"), F.col("raw"))


@query("""with r as (select case_id, candidate_id, arm, not coalesce(hit_token_limit, true) and raw <> '' as good, coalesce(hit_token_limit, false) as bad, raw from candidates where case_id is not null)
select case_id, chosen, rejected from (select g.case_id, g.candidate_id as chosen, b.candidate_id as rejected, row_number() over (partition by g.case_id order by case when g.arm = 'teacher' then 0 else 1 end, g.candidate_id, b.candidate_id) as n from r g join r b on g.case_id = b.case_id and g.good and b.bad and b.arm <> 'teacher' and g.raw is distinct from b.raw) where n = 1""")
def h17_origin_preferred_pairs(spark, d):
    rows = table(spark, d, "candidates").filter("case_id is not null")
    good = rows.filter(~F.coalesce("hit_token_limit", F.lit(True)) & (F.col("raw") != "")).select("case_id", F.col("candidate_id").alias("chosen"), F.when(F.col("arm") == "teacher", 0).otherwise(1).alias("o"), F.col("raw").alias("g"))
    bad = rows.filter("hit_token_limit and arm <> 'teacher'").select("case_id", F.col("candidate_id").alias("rejected"), F.col("raw").alias("b"))
    both = good.join(bad, "case_id").filter(~F.col("g").eqNullSafe(F.col("b")))
    return both.groupBy("case_id").agg(F.min(F.struct("o", "chosen", "rejected")).alias("m")).select("case_id", "m.chosen", "m.rejected")


@query("""with p as (select family_id, row_id, sha256(to_json(example_id)::varchar) as h from examples where family_id is not null and example_id is not null), one as (select row_id, h from (select *, row_number() over (partition by family_id order by h, row_id) as n from p) where n = 1),
c as (select row_id, row_number() over (order by h, row_id) as k, count(*) over () as n from one) select row_id from c where k <= least(n - n % 8, 400)""")
def h19_merged_pairs(spark, d):
    rows = table(spark, d, "examples").filter("family_id is not null and example_id is not null").select("family_id", "row_id", canon.digest_string("example_id").alias("h"))
    one = windows.first_per_group(rows, ["family_id"], [F.col("h"), F.col("row_id")], ["row_id", "h"])
    n = one.count()
    return one.orderBy("h", "row_id").limit(min(n - n % 8, 400)).select("row_id")

