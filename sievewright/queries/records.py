"""Records held against other tables and other deliveries of themselves (the rest of inventory C, D, E, G, H and M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import canon, text
from sievewright.operators import contracts, evaluation, joins, projection, windows
from sievewright.queries.evaluation import _JUDGED, _cases, _judged
from sievewright.queries.registry import query
from sievewright.queries.text import KEY_SQL
from sievewright.queries.windows import GROUP
from sievewright.sources.tables import table

_C = "coalesce({0}, '')"


def _mechanics_sql(t: str, cost: str, p: str, q: str, x: str) -> str:
    return f"sha256({_C.format(KEY_SQL.format(t))} || '|' || {_C.format(cost)} || '|' || {_C.format(p)} || '|' || {_C.format(q)} || '|' || {_C.format(KEY_SQL.format(x))})"


def mechanical_key(prefix: str):
    """Digest of what a design does: type, cost, stats and rules text, in a form that spelling does not change."""
    f = lambda n: F.col(f"{prefix}{n}")
    parts = [text.description_key(f("type_line")), f("mana_cost"), f("power"), f("toughness"), text.description_key(f("oracle_text"))]
    return F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


_INDEX = f"""sides as (select card_no, name as whole, unnest(case when len(card_faces) > 0 then list_transform(card_faces, lambda f: {{n: f.name, t: f.type_line, c: f.mana_cost, p: f.power, q: f.toughness, x: f.oracle_text}}) else [{{n: name, t: type_line, c: mana_cost, p: power, q: toughness, x: oracle_text}}] end) as s from cards),
idx as (select distinct 'name' as kind, {KEY_SQL.format('v')} as key, card_no from (select whole as v, card_no from sides union all select s.n, card_no from sides) where v is not null union select 'mechanics', {_mechanics_sql('s.t', 's.c', 's.p', 's.q', 's.x')}, card_no from sides where s.x <> '')"""


def _index(spark, d):
    """(`kind`, `key`, `card_no`): normalised names of cards and faces, and mechanical keys of all sides with rules text."""
    rows = table(spark, d, "cards").select("card_no", "name", F.explode(projection.sides()).alias("s"))
    names = rows.select(F.explode(F.array("name", "s.name")).alias("v"), "card_no").filter("v is not null").select(F.lit("name").alias("kind"), text.description_key(F.col("v")).alias("key"), "card_no")
    mechanics = rows.filter("s.oracle_text <> ''").select(F.lit("mechanics").alias("kind"), mechanical_key("s.").alias("key"), "card_no")
    return names.unionByName(mechanics).distinct()


@query(f"with {_INDEX} select kind, key, count(*) as cards from idx group by 1, 2")
def c29_name_index(spark, d):
    return _index(spark, d).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("cards"))


@query(f"""with {_INDEX}, q as (select card_id, 'name' as kind, {KEY_SQL.format('draft.name')} as key from custom_cards where draft.name is not null union all select card_id, 'mechanics', {_mechanics_sql('draft.type_line', 'draft.mana_cost', 'draft.power', 'draft.toughness', 'draft.oracle_text')} from custom_cards where draft.oracle_text <> ''),
h as (select card_id, kind, count(*) as n, min(card_no) as first from q join idx using (kind, key) group by 1, 2)
select c.card_id as card_id, h.card_id is null as kept, coalesce(max(case when kind = 'name' then n end), 0) as name_matches, coalesce(max(case when kind = 'mechanics' then n end), 0) as structure_matches, coalesce(min(first), -1) as first_match from custom_cards c left join h on h.card_id = c.card_id group by 1, 2""")
def c17_overlap_with_evidence(spark, d):
    """Designs that are no known card by name or structure are kept; of the others the matches are counted and the first is told."""
    rows = table(spark, d, "custom_cards")
    names = rows.filter("draft.name is not null").select("card_id", F.lit("name").alias("kind"), text.description_key(F.col("draft.name")).alias("key"))
    mechanics = rows.filter("draft.oracle_text <> ''").select("card_id", F.lit("mechanics").alias("kind"), mechanical_key("draft.").alias("key"))
    known = _index(spark, d).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("card_no").alias("first"))  # counted before the join
    hits = names.unionByName(mechanics).join(known, ["kind", "key"])
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    per = hits.groupBy("card_id").agg(of("name").alias("name_matches"), of("mechanics").alias("structure_matches"), F.min("first").alias("first_match"))
    every = rows.select("card_id").join(per, "card_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.select("card_id", F.col("first_match").isNull().alias("kept"), none("name_matches"), none("structure_matches"), F.coalesce("first_match", F.lit(-1)).alias("first_match"))


@query("""select coalesce(a.i, b.i) as i, a.i is not null and b.i is not null as both, a.name is not distinct from b.name as equal from (select wording_id as i, json_extract_string(record, '$.name') as name from printed_wordings) a full join (select card_id as i, draft.name as name from custom_cards) b on a.i = b.i""")
def c22_zip_by_index(spark, d):
    a = table(spark, d, "printed_wordings").select(F.col("wording_id").alias("i"), F.get_json_object("record", "$.name").alias("name"))
    b = table(spark, d, "custom_cards").select(F.col("card_id").alias("i"), F.col("draft.name").alias("other"))
    return contracts.zip_by_index(a, b, "i").select("i", "both", F.col("name").eqNullSafe(F.col("other")).alias("equal"))


@query("""select wording_id, json_extract_string(record, '$.oracle_text') is not distinct from oracle_text as text_equal, json_extract_string(record, '$.set_code') is not distinct from set_code as set_equal from printed_wordings""")
def c23_zip_content_equality(spark, d):
    """Two forms of one wording, its columns and its JSON record, must hold the same."""
    r = F.from_json("record", "oracle_text string, set_code string")
    rows = table(spark, d, "printed_wordings").withColumn("r", r)
    return rows.select("wording_id", F.col("r.oracle_text").eqNullSafe(F.col("oracle_text")).alias("text_equal"), F.col("r.set_code").eqNullSafe(F.col("set_code")).alias("set_equal"))


_FIRST = "(select oracle_id, {0} from (select *, row_number() over (partition by oracle_id order by {1}) as n from {2} where oracle_id is not null) where n = 1)"


@query(f"""select coalesce(a.oracle_id, b.oracle_id) as oracle_id, case when a.oracle_id is null then 'added' when b.oracle_id is null then 'removed' else 'changed' end as change from {_FIRST.format('oracle_text, set_code', 'card_no', 'cards')} a full join {_FIRST.format('oracle_text, set_code', 'wording_id desc', 'printed_wordings')} b on a.oracle_id = b.oracle_id
where a.oracle_id is null or b.oracle_id is null or a.oracle_text is distinct from b.oracle_text or a.set_code is distinct from b.set_code""")
def c24_before_and_after(spark, d):
    """Cards as first delivered against their last printing: added, removed and changed ones."""
    before = windows.first_per_group(table(spark, d, "cards").filter("oracle_id is not null"), ["oracle_id"], [F.col("card_no")], ["oracle_text", "set_code"])
    after = windows.first_per_group(table(spark, d, "printed_wordings").filter("oracle_id is not null"), ["oracle_id"], [-F.col("wording_id")], ["oracle_text", "set_code"])
    return joins.changed_rows(before, after, "oracle_id", ["oracle_text", "set_code"])


_AUDITED = ("name", "rarity", "type_line", "mana_cost", "power", "toughness")


@query(f"""with c as {_FIRST.format(', '.join(_AUDITED), 'card_no', 'cards')}, x as (select row_id, list_filter([{', '.join(f"case when e.target.{f} is distinct from c.{f} then '{f}' end" for f in _AUDITED)}], lambda v: v is not null) as changed from examples e join c on c.oracle_id = e.source.oracle_id)
select row_id, array_to_string(changed, ',') as changed from x where len(changed) > 0""")
def c25_recompute_and_keep_changed(spark, d):
    """Targets against the cards they came from, projected again: only rows that differ, with the fields."""
    raw = windows.first_per_group(table(spark, d, "cards").filter("oracle_id is not null"), ["oracle_id"], [F.col("card_no")], list(_AUDITED))
    rows = table(spark, d, "examples").select("row_id", "target", F.col("source.oracle_id").alias("oracle_id")).join(raw, "oracle_id")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"target.{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in _AUDITED)))
    return rows.select("row_id", F.array_join(changed, ",").alias("changed")).filter("changed <> ''")


@query(f"""select a.oracle_id as oracle_id, a.type_line is not distinct from b.type_line and a.mana_cost is not distinct from b.mana_cost as same from {_FIRST.format('type_line, mana_cost', 'card_no', 'cards')} a join (select oracle_id, json_extract_string(record, '$.type_line') as type_line, json_extract_string(record, '$.mana_cost') as mana_cost from (select *, row_number() over (partition by oracle_id order by wording_id) as n from printed_wordings where oracle_id is not null) where n = 1) b on a.oracle_id = b.oracle_id""")
def c30_reuse_only_if_identical(spark, d):
    """A printing may stand for a card only if type and cost are identical, nulls included."""
    a = windows.first_per_group(table(spark, d, "cards").filter("oracle_id is not null"), ["oracle_id"], [F.col("card_no")], ["type_line", "mana_cost"])
    printed = table(spark, d, "printed_wordings").filter("oracle_id is not null").withColumn("r", F.from_json("record", "type_line string, mana_cost string"))
    b = windows.first_per_group(printed.select("oracle_id", "wording_id", "r.*"), ["oracle_id"], [F.col("wording_id")], ["type_line", "mana_cost"])
    return contracts.same_identity(a, b, "oracle_id", ["type_line", "mana_cost"])


_DIMS = r"""select 'type' as dimension, case when draft.type_line is null then 'none' else trim(string_split(draft.type_line, '—')[1]) end as value from custom_cards union all select 'color', case when len(coalesce(draft.colors, [])) = 0 then 'colorless' when len(draft.colors) > 1 then 'multicolor' else draft.colors[1] end from custom_cards
union all select 'color_combination', coalesce(nullif(array_to_string(list_filter(['W', 'U', 'B', 'R', 'G'], lambda c: list_contains(coalesce(draft.colors, []), c)), ''), ''), 'colorless') from custom_cards union all select 'layout', coalesce(draft.layout, 'missing') from custom_cards union all select 'rarity', coalesce(draft.rarity, 'missing') from custom_cards
union all select 'rules_lines', case when n >= 4 then '4+' else n::varchar end from (select case when trim(coalesce(draft.oracle_text, ''), ' ' || chr(10) || chr(9) || chr(13)) = '' then 0 else len(string_split(trim(draft.oracle_text, ' ' || chr(10) || chr(9) || chr(13)), chr(10))) end as n from custom_cards)"""


@query(f"with x as ({_DIMS}) select dimension, value, count(*) as n from x group by 1, 2 union all select 'source_sets', 'all', count(distinct draft.set_code) from custom_cards")
def d05_coverage_histogram(spark, d):
    """Designs over six derived dimensions in one pass, and how many sets they come from."""
    colors = F.coalesce("draft.colors", F.array().cast("array<string>"))
    trimmed = F.trim(F.coalesce("draft.oracle_text", F.lit("")), F.lit(" \n\t\r"))
    n = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "\n")))
    of = {
        "type": F.when(F.col("draft.type_line").isNull(), "none").otherwise(F.trim(F.split("draft.type_line", "—")[0])),
        "color": F.when(F.size(colors) == 0, "colorless").when(F.size(colors) > 1, "multicolor").otherwise(F.get(colors, F.lit(0))),
        "color_combination": F.when(F.size(projection.in_order(colors)) == 0, "colorless").otherwise(F.array_join(projection.in_order(colors), "")),
        "layout": F.coalesce("draft.layout", F.lit("missing")), "rarity": F.coalesce("draft.rarity", F.lit("missing")), "rules_lines": F.when(n >= 4, "4+").otherwise(n.cast("string")),
    }
    rows = table(spark, d, "custom_cards")
    pairs = F.array(*(F.struct(F.lit(k).alias("dimension"), e.alias("value")) for k, e in of.items()))
    per = rows.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))
    return per.unionByName(rows.agg(F.countDistinct("draft.set_code").alias("n")).select(F.lit("source_sets").alias("dimension"), F.lit("all").alias("value"), "n"))


@query("""with r as (select user_id, event_id, ts, sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as total, row_number() over (partition by user_id order by ts, event_id) as n, row_number() over (partition by user_id order by ts desc, event_id desc) as m from events where value is not null)
select user_id, round(max(case when n = 1 then total end), 6) as inherited, round(max(case when m = 1 then total end), 6) as reported, round(max(case when m = 1 then total end) - max(case when n = 1 then total end), 6) as used, max(case when m = 1 then total end) - max(case when n = 1 then total end) >= 0 as consistent from r group by 1""")
def d14_usage_delta(spark, d):
    """Cumulative usage per user: what the last report adds to the base that was inherited, and that it is not negative."""
    rows = table(spark, d, "events").filter("value is not null")
    per = rows.groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("base"), F.sum("value").alias("all"))
    used = F.col("all") - F.col("base")
    return per.select("user_id", F.round("base", 6).alias("inherited"), F.round("all", 6).alias("reported"), F.round(used, 6).alias("used"), (F.round(used, 9) >= 0).alias("consistent"))


@query("""with s as (select arm, output_tokens as v, row_number() over (partition by arm order by output_tokens) - 1 as i, count(*) over (partition by arm) as n from candidates where output_tokens is not null),
o as (select arm, candidate_id, row_number() over (partition by arm order by candidate_id) as k from candidates where output_tokens > 0.95::double * max_tokens), f as (select arm, count(*) as over_limit, string_agg(case when k <= 10 then candidate_id::varchar end, ',' order by k) as offenders from o group by 1)
select s.arm as arm, min(case when i = n // 2 and n > 0 then v end) as p50, min(case when i = floor((n - 1) * 0.95) then v end) as p95, min(case when i = floor((n - 1) * 0.99) then v end) as p99, max(v) as p100, max(n) as n, max(coalesce(over_limit, 0)) as over_limit, max(offenders) as offenders from s left join f on f.arm is not distinct from s.arm group by 1""".replace("i = n // 2 and n > 0", "i = floor((n - 1) * 0.5)"))
def d15_nearest_rank_percentiles(spark, d):
    """Exact ranks of lengths per arm, how many outputs are near their limit (95 %), and the first ten of these."""
    from sievewright.operators import aggregates

    rows = table(spark, d, "candidates")
    ranks = aggregates.nearest_ranks(rows, ["arm"], "output_tokens", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0})
    over = rows.filter(F.col("output_tokens") > F.lit(0.95) * F.col("max_tokens"))
    n = over.groupBy("arm").agg(F.count(F.lit(1)).alias("over_limit"))
    first = windows.at_most(over.select("arm", "candidate_id"), ["arm"], [F.col("candidate_id")], 10).groupBy("arm").agg(F.array_join(F.transform(F.array_sort(F.collect_list("candidate_id")), lambda x: x.cast("string")), ",").alias("offenders"))
    both = n.join(first, "arm").withColumnRenamed("arm", "a")
    return ranks.join(both, F.col("arm").eqNullSafe(F.col("a")), "left").select(*ranks.columns, F.coalesce("over_limit", F.lit(0)).alias("over_limit"), "offenders")


@query(f"with {_JUDGED} select gate as state, count(*) as n, cast(sum(output_tokens) as bigint) as tokens, count_if(reward is null) as waiting from w group by 1")
def d17_state_progress(spark, d):
    """Outputs by the state they are in, their tokens, and how many wait for a decision."""
    rows = _judged(spark, d).join(table(spark, d, "candidates").select("candidate_id", "output_tokens"), "candidate_id")
    return rows.groupBy(F.col("gate").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("output_tokens").alias("tokens"), F.count_if(F.col("reward").isNull()).alias("waiting"))


_RECOVERY = f"""{_JUDGED}, b as (select case_id, o_text as before, is_json as read_before from w where arm = 'base'), x as (select w.case_id, w.is_json, before, read_before, o_text from w join b using (case_id) where arm = 'repair')"""


@query(f"with {_RECOVERY} select count(*) as attempts, count_if(is_json and o_text is not distinct from before) as unchanged, count_if(is_json and o_text is distinct from before) as rewritten, count_if(not is_json) as held, count_if(is_json and not read_before) as recovered from x")
def d18_recovery_progress(spark, d):
    """Repairs against the base output of the case: unchanged, rewritten, held back as unreadable, and recovered from an unreadable one."""
    rows = _judged(spark, d)
    base = rows.filter("arm = 'base'").select("case_id", F.col("oracle_text").alias("before"), F.col("is_json").alias("read_before"))
    x = rows.filter("arm = 'repair'").join(base, "case_id")
    n = lambda e: F.count_if(F.expr(e))
    return x.agg(F.count(F.lit(1)).alias("attempts"), n("is_json and oracle_text <=> before").alias("unchanged"), n("is_json and not (oracle_text <=> before)").alias("rewritten"), n("not is_json").alias("held"), n("is_json and not read_before").alias("recovered"))


_TARGET_FEATURES = "t0 as (select row_id, style, target.type_line as t, target.oracle_text as x, list_filter(['W', 'U', 'B', 'R', 'G'], lambda c: contains(coalesce(target.mana_cost, ''), c)) as cs from examples), "


def _pattern_union() -> str:
    from sievewright.queries.cards import _PATTERNS, _TYPES

    return f"""{_TARGET_FEATURES} f as (select row_id, unnest(list_filter([{_PATTERNS}], lambda v: v is not null)) as feature from t0 union select row_id, 'layout:normal' from t0 union select row_id, 'type:' || w from (select row_id, unnest(string_split_regex(lower(string_split(t, '—')[1]), '[ ]+')) as w from t0) where w in ({_TYPES}) union select row_id, 'color:' || unnest(cs) from t0
 union select row_id, 'color_bucket:' || case when len(cs) = 0 then 'colorless' when len(cs) > 1 then 'multicolor' else cs[1] end from t0 union select row_id, 'color_combination:' || case when len(cs) = 0 then 'C' else array_to_string(cs, '') end from t0 union select row_id, 'style:' || style from t0 where style is not null)"""


@query(f"with {_pattern_union()} select feature, count(*) as n from f group by 1")
def d27_pilot_coverage(spark, d):
    """Rows per feature of their target, and per style."""
    none = F.lit(None).cast("string")
    made = text.features(none, F.col("target.type_line"), F.col("target.oracle_text"), text.colors_of(F.coalesce("target.mana_cost", F.lit(""))))
    style = F.when(F.col("style").isNotNull(), F.array(F.concat(F.lit("style:"), F.col("style")))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "examples").select(F.explode(F.concat(made, style)).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("""select oracle_id, 'only printed' as side from (select oracle_id from printed_wordings where oracle_id is not null except select oracle_id from cards) union all select oracle_id, 'only cards' from (select oracle_id from cards where oracle_id is not null except select oracle_id from printed_wordings)""")
def g05_set_equality(spark, d):
    """Identities that only one of two tables has; equal sets give no row."""
    of = lambda name: table(spark, d, name).select("oracle_id").filter("oracle_id is not null").distinct()
    printed, cards = of("printed_wordings"), of("cards")
    return printed.subtract(cards).withColumn("side", F.lit("only printed")).unionByName(cards.subtract(printed).withColumn("side", F.lit("only cards")))


@query("""select target.type_line as prompt, style, count(distinct target.name) as targets, count(*) as n from examples where style is not null and target.type_line is not null group by 1, 2 having count(distinct target.name) > 1""")
def g08_ambiguous_prompts(spark, d):
    """Prompts of the sparsest kind, a type in a style, that stand for several targets."""
    rows = table(spark, d, "examples").filter("style is not null and target.type_line is not null").select(F.col("target.type_line").alias("prompt"), "style", F.col("target.name").alias("name"))
    per = rows.groupBy("prompt", "style", "name").agg(F.count(F.lit(1)).alias("n"))  # names collapse before they are counted
    return per.groupBy("prompt", "style").agg(F.count("name").alias("targets"), F.sum("n").alias("n")).filter("targets > 1")


@query("""select distinct e.target.type_line as type_line from examples e where e.split = 'test' and e.target.type_line is not null and not exists (select 1 from examples t where t.split = 'train' and t.target.type_line = e.target.type_line)""")
def g09_missing_features(spark, d):
    """Type lines of test targets that no training target has."""
    rows = table(spark, d, "examples").select("split", "target.type_line").filter("type_line is not null")
    return rows.filter("split = 'test'").select("type_line").distinct().join(rows.filter("split = 'train'"), "type_line", "left_anti")


@query("""with a as (select distinct arm from candidates where arm is not null), c as (select distinct example_id as case_id from examples where split in ('validation', 'test') and example_id is not null), g as (select case_id, arm from c, a), k as (select case_id, arm, count(*) as n from candidates where case_id is not null and arm is not null group by 1, 2)
select arm, 'missing' as state, count(*) as n from g left join k using (case_id, arm) where n is null group by 1 union all select arm, 'repeated', count(*) from k join c using (case_id) where n > 1 group by 1 union all select arm, 'extra', count(*) from k left join c using (case_id) where c.case_id is null group by 1""")
def g10_schedule_grid(spark, d):
    """Outputs against the schedule, one for every case and arm: missing, repeated and of no case. Missing ones are a difference of counts."""
    from sievewright.sources.shared import materialize

    cases = _cases(spark, d).select("case_id", F.lit(True).alias("known"))
    rows = table(spark, d, "candidates").filter("case_id is not null and arm is not null").groupBy("case_id", "arm").agg(F.count(F.lit(1)).alias("n"))
    held = materialize(rows.join(cases, "case_id", "left"), "held")
    n = lambda e: F.count_if(F.expr(e))
    per = held.groupBy("arm").agg(n("known").alias("have"), n("known and n > 1").alias("repeated"), n("known is null").alias("extra"))
    total = cases.count()
    states = F.array(*(F.struct(F.lit(s).alias("state"), e.alias("n")) for s, e in (("missing", F.lit(total).cast("long") - F.col("have")), ("repeated", F.col("repeated")), ("extra", F.col("extra")))))
    return per.select("arm", F.explode(states).alias("s")).select("arm", "s.state", "s.n").filter("n > 0")


@query("""select lower(trim(source)) as source, count(*) as rows, count_if(n_chars = length(text)) as agreeing, count_if(n_chars is null) as unpublished, cast(sum(n_chars) as bigint) as published, cast(sum(length(text)) as bigint) as recomputed from documents where text is not null group by 1""")
def g12_recomputed_totals(spark, d):
    """Published lengths against lengths counted again, per source."""
    rows = table(spark, d, "documents").filter("text is not null").select(F.lower(F.trim("source")).alias("source"), "n_chars", F.length("text").cast("long").alias("n"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n_chars") == F.col("n")).alias("agreeing"), F.count_if(F.col("n_chars").isNull()).alias("unpublished"), F.sum("n_chars").alias("published"), F.sum("n").alias("recomputed"))


@query("""with o as (select oracle_id, sha256(coalesce(oracle_text, '') || '|' || coalesce(type_line, '')) as h, row_number() over (partition by oracle_id order by card_no) as n, row_number() over (partition by oracle_id order by card_no desc) as m from cards where oracle_id is not null)
select a.oracle_id as oracle_id, a.h = b.h as reusable from o a join o b on a.oracle_id = b.oracle_id and a.n = 1 and b.m = 1""")
def g14_reusable_derivation(spark, d):
    """What was derived from a card's first delivery may be used for its last only if both are identical."""
    h = F.sha2(F.concat(F.coalesce("oracle_text", F.lit("")), F.lit("|"), F.coalesce("type_line", F.lit(""))), 256)
    rows = table(spark, d, "cards").filter("oracle_id is not null").select("oracle_id", "card_no", h.alias("h"))
    a = windows.first_per_group(rows, ["oracle_id"], [F.col("card_no")], ["h"])
    b = windows.first_per_group(rows, ["oracle_id"], [-F.col("card_no")], ["h"])
    return contracts.same_identity(a, b, "oracle_id", ["h"]).withColumnRenamed("same", "reusable")


_RANK = "sha256('[\"replay-order\", ' || to_json(example_id)::varchar || ']')"


@query(f"""with t as (select count(distinct {GROUP}) as n from examples where split = 'train' and origin = 'custom'), x as (select distinct {GROUP} as g from examples where split = 'test' and source_group_id is not null),
p as (select row_id, {_RANK} as h, contains(coalesce(target.type_line, ''), 'Planeswalker') as walker, row_number() over (partition by {GROUP} order by {_RANK}, row_id) as k from examples where split = 'train' and origin = 'official' and example_id is not null and source_group_id is not null and {GROUP} not in (select g from x)),
o as (select * from p where k = 1), a as (select row_id from (select row_id, row_number() over (order by h, row_id) as r from o where walker), t where r <= least(192, n // 10)), b as (select row_id from (select row_id, row_number() over (order by h, row_id) as r from o where row_id not in (select row_id from a)), t where r <= n - (select count(*) from a))
select row_id, 'walker' as stratum from a union all select row_id, 'rest' from b""")
def h10_one_to_one_replay(spark, d):
    """For each custom family in training one official family that is not in test, up to a tenth and 192 of them planeswalkers."""
    rows = table(spark, d, "examples").withColumn("g", F.lower(F.trim("source_group_id")))
    n = rows.filter("split = 'train' and origin = 'custom'").select("g").filter("g is not null").distinct().count()
    held = rows.filter("split = 'test' and g is not null").select("g").distinct()
    rank = canon.digest_list(F.lit("replay-order"), F.col("example_id"))
    pool = rows.filter("split = 'train' and origin = 'official' and example_id is not null and g is not null").join(held, "g", "left_anti")
    walker = F.contains(F.coalesce("target.type_line", F.lit("")), F.lit("Planeswalker"))
    one = windows.first_per_group(pool.select("g", "row_id", rank.alias("h"), walker.alias("walker")), ["g"], [F.col("h"), F.col("row_id")], ["row_id", "h", "walker"])
    a = one.filter("walker").orderBy("h", "row_id").limit(min(192, n // 10)).select("row_id")
    b = one.join(a, "row_id", "left_anti").orderBy("h", "row_id").limit(n - a.count()).select("row_id")
    return a.withColumn("stratum", F.lit("walker")).unionByName(b.withColumn("stratum", F.lit("rest")))


@query("with h as (select row_id, ('0x' || substr(sha256(to_json(example_id)::varchar), 1, 8))::bigint as n from examples where example_id is not null) select row_id, " + " || ' ' || ".join(f"{p}[(n // {16**i}) % 16 + 1]" for i, p in enumerate(text.PARTS)) + " as name from h where n % 4 = 0")
def h12_composed_variation(spark, d):
    """A name of three parts for a quarter of the rows, each part by four bits of the identifier's hash."""
    n = canon.hash_number(canon.digest_string("example_id"))
    rows = table(spark, d, "examples").filter("example_id is not null").select("row_id", n.alias("n")).filter("n % 4 = 0")
    return rows.select("row_id", text.composed_name(F.col("n")).alias("name"))


@query(f"""with {_JUDGED}, b as (select * from w where arm = 'base' and gate <> 'judge_abstention'), mended as (select case_id, candidate_id as rid, gate as rgate from w where arm = 'repair' and schema_valid)
select b.case_id as case_id, coalesce(rid, candidate_id) as candidate_id, rid is not null as replaced, coalesce(rgate, gate) as gate from b left join mended using (case_id)""")
def h20_refine(spark, d):
    """Base outputs without those that no judge decided, repaired ones in place of theirs, each with the gate of what now stands."""
    rows = _judged(spark, d)
    repaired = rows.filter("arm = 'repair' and schema_valid").select("case_id", F.col("candidate_id").alias("rid"), F.col("gate").alias("rgate"))
    kept = rows.filter("arm = 'base' and gate <> 'judge_abstention'").select("case_id", "candidate_id", "gate").join(repaired, "case_id", "left")
    return kept.select("case_id", F.coalesce("rid", "candidate_id").alias("candidate_id"), F.col("rid").isNotNull().alias("replaced"), F.coalesce("rgate", "gate").alias("gate"))


@query(f"""with {_JUDGED}, p as (select case_id, candidate_id as prior, raw as prior_raw, schema_valid as ok from w where arm = 'sft')
select w.case_id as case_id, case when not w.schema_valid and coalesce(ok, false) then prior else candidate_id end as kept, not w.schema_valid and coalesce(ok, false) as adopted from w left join p using (case_id) where arm = 'dpo'""")
def m07_adopt_prior(spark, d):
    """The prior arm's output where the new one fails the schema and the prior, checked again, does not."""
    rows = _judged(spark, d)
    prior = rows.filter("arm = 'sft'").select("case_id", F.col("candidate_id").alias("prior"), F.col("schema_valid").alias("ok"))
    adopt = ~F.col("schema_valid") & F.coalesce("ok", F.lit(False))
    both = rows.filter("arm = 'dpo'").select("case_id", "candidate_id", "schema_valid").join(prior, "case_id", "left")
    return both.select("case_id", F.when(adopt, F.col("prior")).otherwise(F.col("candidate_id")).alias("kept"), adopt.alias("adopted"))


@query(f"""select card_id, replace(draft.type_line, draft.name, 'CARDNAME') as type_line, replace(draft.oracle_text, draft.name, 'CARDNAME') as oracle_text, replace(draft.rarity, draft.name, 'CARDNAME') as rarity, array_to_string(list_transform(draft.colors, lambda c: replace(c, draft.name, 'CARDNAME')), '') as colors from custom_cards where draft.name <> ''""")
def i17_bind_every_leaf(spark, d):
    """A design's name replaced in every string of its nested record."""
    rows = table(spark, d, "custom_cards").filter("draft.name <> ''")
    bound = text.map_strings(F.col("draft"), rows.schema["draft"].dataType, lambda c: F.replace(c, F.col("draft.name"), F.lit("CARDNAME")))
    return rows.select("card_id", bound.alias("b")).select("card_id", "b.type_line", "b.oracle_text", "b.rarity", F.array_join("b.colors", "").alias("colors"))


_DIM = "avg(('0x' || substr(md5(tok), {0}, 1))::bigint / 15.0::double)"


@query(f"""with w as (select doc_id, regexp_extract_all(text, '[^\\s]+', 0) as t from documents where text is not null), x as (select doc_id, t, i, unnest(t[i * 448 + 1:i * 448 + 480]) as tok from w, lateral (select unnest(generate_series(0, greatest(cast(ceil((len(t) - 480) / 448.0) as bigint), 0))) as i) where len(t) > 0),
p as (select doc_id, i, count(*) as tokens, {", ".join(f"{_DIM.format(k)} as v{k}" for k in range(1, 5))} from x group by 1, 2), n as (select *, sqrt(v1 * v1 + v2 * v2 + v3 * v3 + v4 * v4) as norm from p)
select doc_id, i as "window", tokens, round(v1 / nullif(norm, 0), 4) as v1, round(v2 / nullif(norm, 0), 4) as v2, round(v3 / nullif(norm, 0), 4) as v3, round(v4 / nullif(norm, 0), 4) as v4 from n""".replace("\\\\", "\\"))
def i24_token_windows(spark, d):
    """Overlapping windows over the tokens of a text, their token vectors averaged and brought to length 1.

    No encoder is shipped: a token's vector is made of the first digits of its digest.
    """
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0)).alias("t"))
    windows_ = docs.select("doc_id", "t", F.explode(text.word_windows(F.size("t").cast("long"))).alias("first")).select("doc_id", F.expr("first div 448").alias("window"), F.expr("slice(t, int(first) + 1, 480)").alias("t"))
    digits = lambda tok: F.array(*(F.conv(F.substring(F.md5(tok.cast("binary")), k, 1), 16, 10).cast("double") / 15 for k in range(1, 5)))
    pooled = text.pooled(F.transform("t", digits), 4)
    return windows_.select("doc_id", "window", F.size("t").cast("long").alias("tokens"), pooled.alias("v")).select("doc_id", "window", "tokens", *(F.round(F.get("v", F.lit(k - 1)), 4).alias(f"v{k}") for k in range(1, 5)))


@query("""select row_id, length(description)::varchar as result, 'done' as status from examples where description <> ''""")
def m16_content_addressed_calls(spark, d):
    """A call for each distinct description only; its result is found by the hash of its input, pin included."""
    from sievewright.operators import boundary

    rows = table(spark, d, "examples").filter("description <> ''").select("row_id", "description")
    none = spark.createDataFrame([], "content_hash string, status string, result string")
    found, _ = boundary.cached(rows, "row_id", "description", none, lambda: lambda items: [str(len(x)) for x in items], "pin-2")
    return found.select("row_id", "result", "status")
