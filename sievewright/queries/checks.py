"""Checks of descriptions and targets, chat shapes and token masks (inventory J08, J09, J16 to J18, J20, J21, K02 to K05, K08, K15, K23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import text
from sievewright.operators import boundary, checks, contracts, evaluation
from sievewright.queries.evaluation import _JUDGED, _PARSE, _judged
from sievewright.queries.registry import query
from sievewright.queries.text import BARE_SQL, KEY_SQL, STRIP_SQL, WORDS_SQL
from sievewright.sources.tables import table

_HELD = "contains(' ' || {0} || ' ', ' ' || {1} || ' ')"
_W = WORDS_SQL.format("regexp_replace({0}, '^[,.;]+|[,.;]+$', '', 'g')")


def _said(w: str, joined: str = "dw") -> str:
    one = _W.replace("{0}", w)
    plural = f"case when {one} like '%y' then regexp_replace({one}, 'y$', 'ies') when {one} like '%s' then {one} || 'es' else {one} || 's' end"
    return f"({_HELD.format(joined, one)} or {_HELD.format(joined, plural)})"


_KINDS = "['" + "', '".join(checks.ENCHANTMENT_KINDS) + "']"
_ISSUES = rf"""e0 as (select row_id, style, origin, description, target, target.type_line as tl, {WORDS_SQL.format('description')} as dw, coalesce(target.type_line, '') as kind, case when contains(coalesce(target.type_line, ''), ' — ') then list_filter(string_split_regex(string_split(target.type_line, ' — ')[-1], '\s+'), lambda w: w <> '') else [] end as sub,
 regexp_matches(description, '\b[0-9]+\s*/\s*[0-9]+\b') as stats from examples where description is not null),
e1 as (select *, stats or (contains(kind, 'Creature') and len(sub) > 0 and len(list_filter(sub, lambda w: not {_said('w')})) = 0) or regexp_matches(description, '(?i)\b(?:flyer|flier)s?\b') as creature_ok, {_said("'walker'")} as walker_ok,
 regexp_matches(description, '(?i)\bmana rocks?\b') or (list_contains(sub, 'Equipment') and {_said("'Equipment'")}) as artifact_ok, len(list_filter({_KINDS}, lambda k: list_contains(sub, k) and {_said('k')})) > 0 as ench_ok from e0),
e2 as (select *, list_sort(list_distinct(list_concat(list_filter([case when target.mana_cost <> '' and not list_contains(regexp_extract_all(description, '(?:\{{[0-9A-Z/]+\}})+', 0), target.mana_cost) then 'missing_or_changed_mana_cost:' || target.mana_cost end,
 case when target.power is not null and not contains(replace(description, ' ', ''), target.power || '/' || coalesce(target.toughness, '')) then 'missing_or_changed_stats' end, case when style in ('minimal', 'concept') and target.mana_cost is null and regexp_matches(description, '\{{[^}}]+\}}') then 'detail_level_leaked_mana_cost' end,
 case when style in ('minimal', 'concept') and target.power is null and stats then 'detail_level_leaked_exact_stats' end, case when length(description) > 12000 or trim(description) = '' then 'invalid_description_length' end], lambda v: v is not null),
 list_transform(list_filter(string_split_regex(kind, '\s+|—|//'), lambda w: w <> '' and not (case w when 'Creature' then creature_ok when 'Planeswalker' then walker_ok when 'Artifact' then artifact_ok when 'Enchantment' then ench_ok else false end) and not {_said('w')}), lambda w: 'missing_type_word:' || w)))) as issues from e1)"""
_LEAK = f"""n0 as (select row_id, description, target, {WORDS_SQL.format('target.name')} as needle, {WORDS_SQL.format('description')} as dw, {WORDS_SQL.format("coalesce(target.type_line, '')")} as tw, {WORDS_SQL.format("coalesce(target.oracle_text, '')")} as ow,
 list_transform(list_filter([['W', 'white'], ['U', 'blue'], ['B', 'black'], ['R', 'red'], ['G', 'green']], lambda p: contains(coalesce(target.mana_cost, ''), p[1])), lambda p: p[2]) as cn from examples where description is not null),
n1 as (select row_id, coalesce(length(target.name) > 4 and needle <> '' and {_HELD.format('dw', 'needle')} and len(list_filter(string_split(needle, ' '), lambda w: not list_contains(list_concat(string_split(tw, ' '), cn), w))) > 0 and not {_HELD.format('tw', 'needle')} and not {_HELD.format('ow', 'needle')}
 and not (needle = 'regeneration' and regexp_matches(coalesce(target.oracle_text, ''), '(?i)\\bregenerate\\b')), false) as leaks from n0)""".replace("\\\\b", "\\b")


def _described(spark, d):
    rows = table(spark, d, "examples").filter("description is not null")
    colors = text.colors_of(F.coalesce("target.mana_cost", F.lit("")))
    leak = checks.name_leak(F.col("description"), F.col("target.name"), F.col("target.type_line"), colors, F.col("target.oracle_text"))
    return rows.withColumns({"issues": checks.description_issues(F.col("description"), F.col("style")), "leaks": leak})


@query(f"with {_ISSUES} select row_id, array_to_string(issues, ',') as issues from e2")
def k02_issue_codes(spark, d):
    return _described(spark, d).select("row_id", F.array_join("issues", ",").alias("issues"))


@query(f"with {_LEAK} select row_id, leaks from n1")
def k03_name_leak(spark, d):
    return _described(spark, d).select("row_id", "leaks")


_ALL = "list_sort(case when leaks then list_append(issues, 'source_name_leak') else issues end)"


@query(f"with {_ISSUES}, {_LEAK}, c as (select e2.style, {_ALL} as codes from e2 join n1 using (row_id)) select style, count(*) as n, count_if(len(codes) = 0) as clean, cast(sum(len(codes)) as bigint) as issues from c group by 1")
def k04_combined_checks(spark, d):
    """Issues and leaks of each description together, per style."""
    every = F.concat("issues", F.when(F.col("leaks"), F.array(F.lit("source_name_leak"))).otherwise(F.array().cast("array<string>")))
    return _described(spark, d).select("style", F.size(every).alias("k")).groupBy("style").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") == 0).alias("clean"), F.sum("k").alias("issues"))


_CONTROL = "v as (select case_id, bool_or(verdict = 'pass') as review from w group by 1), k as (select case_id, count_if(coalesce(verdict, '') <> 'pass') as rejected, count_if(verdict is not null) as judged from w group by 1)"


@query(f"""with {_ISSUES}, {_LEAK}, {_JUDGED}, {_CONTROL}, x as (select e2.row_id, {_ALL} as issues, v.review, k.judged > 0 as controls, coalesce(e2.target.type_line, '') <> '' and e2.target.oracle_text is not null as valid from e2 join n1 using (row_id) join examples e on e.row_id = e2.row_id left join v on v.case_id = e.example_id left join k on k.case_id = e.example_id where e.split in ('validation', 'test')),
y as (select row_id, list_sort(list_filter(list_concat(issues, [case when not coalesce(review, false) then 'review_not_passed' end, case when not coalesce(controls, false) then 'controls_failed' end, case when not coalesce(valid, false) then 'invalid_schema' end]), lambda z: z is not null)) as reasons from x)
select row_id, case when len(reasons) = 0 then 'accepted' else 'quarantined' end as route, array_to_string(reasons, ',') as reasons from y""")
def k05_admission_gate(spark, d):
    """Held-out descriptions: accepted if an arm's output passed review, nothing is wrong, a control was judged and the target is whole."""
    rows = _described(spark, d).filter("split in ('validation', 'test')")
    judged = _judged(spark, d).groupBy("case_id").agg(F.bool_or(F.col("verdict") == "pass").alias("review"), (F.count("verdict") > 0).alias("controls"))
    rows = rows.join(judged, F.col("example_id") == F.col("case_id"), "left")
    every = F.concat("issues", F.when(F.col("leaks"), F.array(F.lit("source_name_leak"))).otherwise(F.array().cast("array<string>")))
    valid = (F.coalesce("target.type_line", F.lit("")) != "") & F.col("target.oracle_text").isNotNull()
    route, reasons = checks.admission(F.col("review"), every, F.col("controls"), valid)
    return rows.select("row_id", route.alias("route"), F.array_join(reasons, ",").alias("reasons"))


@query(f"""with {_JUDGED}, c as (select case_id, count_if(coalesce(verdict, '') <> 'pass') as rejected, count(*) as checked, bool_or(style = 'broad') as completion from w group by 1)
select case_id, rejected, checked, rejected >= 3 and (not completion or checked = 4) as valid from c""")
def k08_control_pattern(spark, d):
    """Fidelity controls of a case: at least three outputs rejected; a completion case (broad) has four checked."""
    per = _judged(spark, d).groupBy("case_id").agg(F.count_if(F.coalesce("verdict", F.lit("")) != "pass").alias("rejected"), F.count(F.lit(1)).alias("checked"), F.bool_or(F.col("style") == "broad").alias("completion"))
    return per.select("case_id", "rejected", "checked", ((F.col("rejected") >= 3) & (~F.col("completion") | (F.col("checked") == 4))).alias("valid"))


_BARE = STRIP_SQL.format(BARE_SQL.format("t"))


@query(f"""with a as (select card_id, draft.oracle_text as t from custom_cards where draft.oracle_text is not null), b as (select *, case when not regexp_matches({BARE_SQL.format('t')}, '[()]') then {_BARE} end as bare from a),
p as (select *, {_PARSE.format('bare')} as bs, {_PARSE.format('t')} as ws, coalesce(bare <> t, true) as drops, regexp_replace({KEY_SQL.format('bare')}, '[{{}}]', '', 'g') as bm, regexp_replace({KEY_SQL.format(BARE_SQL.format('t'))}, '[{{}}]', '', 'g') as m from b),
q as (select *, bs = 'rejected' and drops as kept from p),
r as (select *, case when coalesce(case when kept then ws else bs end, '') <> 'parsed' then 'unreadable' when not coalesce(kept or bm = m, false) then 'changed_meaning' when not drops then 'absent' when kept then 'retained_for_parser' else 'removed' end as policy from q)
select card_id, policy, sha256(case when policy = 'retained_for_parser' then t when policy in ('absent', 'removed') then bare end) as text_hash from r""")
def k15_canonical_target(spark, d):
    """Rules text without reminders where the (stand-in) parser still reads it and its meaning, the words outside parentheses, is the same."""
    rows = table(spark, d, "custom_cards").filter("draft.oracle_text is not null").select("card_id", F.col("draft.oracle_text").alias("t"))
    bare = text.without_parentheses(F.col("t"))
    opened = F.length(F.regexp_replace("t", r"[^(]", ""))
    outside = F.aggregate(F.sequence(F.lit(0), opened), F.col("t"), lambda t, _: F.regexp_replace(t, r"\([^()]*\)", ""))
    meaning = lambda c: F.regexp_replace(text.description_key(c), "[{}]", "")
    canonical, policy = checks.canonical_target(F.col("t"), evaluation.balanced_text(bare), evaluation.balanced_text(F.col("t")), meaning(bare), meaning(outside))
    return rows.select("card_id", policy.alias("policy"), F.sha2(canonical, 256).alias("text_hash"))


_K23 = "select c.card_id, coalesce(c.validation.parse_complete, false) as target_pass, list_filter(['complete', 'concept', 'minimal'], lambda s: list_contains(st.styles, s)) as styles from custom_cards c left join (select family_id, list(distinct style) as styles from examples where family_id is not null group by 1) st on st.family_id = c.family_id"


@query(f"with x as ({_K23}) select len(coalesce(styles, [])) as styles_passed, count(*) as cards, count_if(target_pass) as target_pass, count_if(target_pass and len(coalesce(styles, [])) = 3) as admitted from x group by 1")
def k23_joint_admission(spark, d):
    """Designs by how many of three styles describe their family, and those admitted: the target is parsed and all three are there."""
    wanted = F.array(*map(F.lit, ("complete", "concept", "minimal")))
    styles = table(spark, d, "examples").filter("family_id is not null").groupBy("family_id").agg(F.collect_set("style").alias("s"))  # a few styles
    rows = table(spark, d, "custom_cards").join(styles, "family_id", "left")
    n, passed = F.size(F.array_intersect(wanted, F.coalesce("s", F.array().cast("array<string>")))), F.coalesce("validation.parse_complete", F.lit(False))
    x = rows.select(n.cast("long").alias("styles_passed"), passed.alias("p"))
    return x.groupBy("styles_passed").agg(F.count(F.lit(1)).alias("cards"), F.count_if("p").alias("target_pass"), F.count_if(F.col("p") & (F.col("styles_passed") == 3)).alias("admitted"))


@query("""select card_id, draft.name as name, coalesce(draft.layout, 'normal') as layout, lower(draft.set_code) as "set", draft.type_line as type_line, coalesce(draft.oracle_text, '') as oracle_text, coalesce(draft.mana_cost, '') as mana_cost, array_to_string(list_filter(['W', 'U', 'B', 'R', 'G'], lambda c: list_contains(coalesce(draft.colors, []), c)), '') as colors,
case when draft.power is not null then draft.power || '/' || coalesce(draft.toughness, '') end as stats, lower(draft.set_code) || ':' || card_id as source_id from custom_cards where draft.name is not null""")
def j08_convert_export(spark, d):
    """Designs in the shape of an export: defaults, lower-case set, ordered colours, joined stats and a source identifier."""
    from sievewright.operators.projection import in_order

    c = lambda f: F.col(f"draft.{f}")
    stats = F.when(c("power").isNotNull(), F.concat(c("power"), F.lit("/"), F.coalesce(c("toughness"), F.lit(""))))
    return table(spark, d, "custom_cards").filter("draft.name is not null").select(
        "card_id", c("name").alias("name"), F.coalesce(c("layout"), F.lit("normal")).alias("layout"), F.lower(c("set_code")).alias("set"), c("type_line").alias("type_line"), F.coalesce(c("oracle_text"), F.lit("")).alias("oracle_text"),
        F.coalesce(c("mana_cost"), F.lit("")).alias("mana_cost"), F.array_join(in_order(F.coalesce(c("colors"), F.array().cast("array<string>"))), "").alias("colors"), stats.alias("stats"), F.concat(F.lower(c("set_code")), F.lit(":"), F.col("card_id").cast("string")).alias("source_id"),
    )


_FIELDS = ("name", "rarity", "type_line", "oracle_text", "power", "toughness", "mana_cost")
_JSON = "'{' || concat_ws(',', " + ", ".join(f"""'"{f}":' || to_json(target.{f})::varchar""" for f in _FIELDS) + ") || '}'"


def design_json(target: str = "target"):
    """Compact JSON of a target without its nulls."""
    return F.to_json(F.struct(*(F.col(f"{target}.{f}") for f in _FIELDS)))


@query(f"""select row_id, 'system' as role, 'style: ' || coalesce(style, 'any') as content, 0 as pos from examples where description <> '' and target is not null union all select row_id, 'user', description, 1 from examples where description <> '' and target is not null union all select row_id, 'assistant', {_JSON}, 2 from examples where description <> '' and target is not null""")
def j09_chat_messages(spark, d):
    """Three messages a row, the last with the whole target as compact JSON."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(message("system", F.concat(F.lit("style: "), F.coalesce("style", F.lit("any")))), message("user", F.col("description")), message("assistant", design_json()))
    rows = table(spark, d, "examples").filter("description <> '' and target is not null")
    return rows.select("row_id", F.posexplode(messages).alias("pos", "m")).select("row_id", "m.role", "m.content", "pos")


_TOKENS = r"regexp_extract_all({0}, '\s+|[^\s]+', 0)"


@query(f"""with a as (select row_id, description || ' ' as prompt, target.oracle_text as answer from examples where description is not null and target.oracle_text is not null), b as (select row_id, {_TOKENS.format('prompt')} as p, {_TOKENS.format('prompt || answer')} as w from a)
select row_id, len(p) as masked, len(w) - len(p) as kept, w[1:len(p)] = p as prefix_exact, len(w) <= 200 as fits, repeat('0', len(p)) || repeat('1', greatest(len(w) - len(p), 0)) as mask from b""")
def j16_completion_mask(spark, d):
    """0 for the tokens of the prompt, then 1 for those of the answer; whether the prompt's tokens begin the whole, and whether it fits."""
    tokens = lambda c: F.regexp_extract_all(c, F.lit(r"\s+|[^\s]+"), F.lit(0))
    rows = table(spark, d, "examples").filter("description is not null and target.oracle_text is not null").withColumn("prompt", F.concat("description", F.lit(" ")))
    rows = rows.select("row_id", tokens(F.col("prompt")).alias("p"), tokens(F.concat("prompt", "target.oracle_text")).alias("w"))
    n, m = F.size("p"), F.size("w") - F.size("p")
    mask = F.array_join(F.concat(F.array_repeat(F.lit("0"), n), F.array_repeat(F.lit("1"), F.greatest(m, F.lit(0)))), "")
    return rows.select("row_id", n.cast("long").alias("masked"), m.cast("long").alias("kept"), (F.slice("w", F.lit(1), n) == F.col("p")).alias("prefix_exact"), (F.size("w") <= 200).alias("fits"), mask.alias("mask"))


@query(rf"select doc_id, len({_TOKENS.format('text')}) as tokens, true as exact from documents where text is not null")
def j17_verified_tokens(spark, d):
    """Tokens per text in Arrow batches, each batch checked: the tokens put together again are the text."""
    return boundary.verified_tokens(table(spark, d, "documents").filter("text is not null"), "doc_id", "text", boundary.blank_tokens)


@query(f"""with {_JUDGED}, c as (select case_id, arg_min(raw, candidate_id) as chosen from w where verdict = 'pass' and confidence = 'high' group by 1), x as (select case_id, arg_min(raw, candidate_id) as rejected from w where wrong group by 1), p as (select c.case_id as case_id, cases.description as prompt, chosen, rejected from c join x using (case_id) join cases on cases.case_id = c.case_id)
select case_id, coalesce(trim(prompt) <> '' and chosen <> '' and rejected <> '' and chosen <> rejected, false) as well_formed, coalesce(greatest(len({_TOKENS.format("prompt || chr(10) || chosen")}), len({_TOKENS.format("prompt || chr(10) || rejected")})) <= 400, false) as fits from p""")
def j18_preference_rows(spark, d):
    """Judged pairs rendered behind their prompt: both answers there and different, neither cut by the limit."""
    rows = _judged(spark, d)
    first = lambda df, name: df.groupBy("case_id").agg(F.min_by("raw", "candidate_id").alias(name))
    good = rows.filter("verdict = 'pass' and confidence = 'high'")
    pairs = first(good, "chosen").join(first(rows.filter("wrong"), "rejected"), "case_id").join(rows.groupBy("case_id").agg(F.min("description").alias("prompt")), "case_id")
    n = lambda c: F.size(F.regexp_extract_all(F.concat("prompt", F.lit("\n"), c), F.lit(r"\s+|[^\s]+"), F.lit(0)))
    formed = (F.trim("prompt") != "") & (F.col("chosen") != "") & (F.col("rejected") != "") & (F.col("chosen") != F.col("rejected"))
    return pairs.select("case_id", F.coalesce(formed, F.lit(False)).alias("well_formed"), F.coalesce(F.greatest(n("chosen"), n("rejected")) <= 400, F.lit(False)).alias("fits"))


@query(f"""with {_JUDGED} select candidate_id, 'Current design:' || chr(10) || raw || chr(10) || 'Change:' || chr(10) || coalesce(description, '') || chr(10) || 'Diagnostic:' || chr(10) || case when len(issues) > 0 then array_to_string(issues, ', ') else gate end as prompt, {_JSON} as completion from w where is_object and gate <> 'faithful_candidate'""")
def j20_repair_messages(spark, d):
    """A repair prompt for every output that is an object but no faithful one, and the target as its completion."""
    rows = _judged(spark, d).filter("is_object and gate <> 'faithful_candidate'")
    told = F.when(F.size("issues") > 0, F.array_join("issues", ", ")).otherwise(F.col("gate"))
    prompt = F.concat_ws("\n", F.lit("Current design:"), "raw", F.lit("Change:"), F.coalesce("description", F.lit("")), F.lit("Diagnostic:"), told)
    return rows.select("candidate_id", prompt.alias("prompt"), design_json().alias("completion"))


@query("""select split, count(*) as prompts, count(distinct example_id) as ids, count(*) - count(distinct example_id) as repeated, count_if(coalesce(trim(description), '') <> '') as valid from examples where split in ('validation', 'test') group by 1""")
def j21_prompt_table(spark, d):
    """Prompts of a system and a user message only; identifiers must be unique."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    rows = table(spark, d, "examples").filter("split in ('validation', 'test')")
    valid = contracts.roles_valid(F.array(m("system", F.lit("Design a card.")), m("user", F.col("description"))), (("system", "user"),))
    per = rows.groupBy("split").agg(F.count(F.lit(1)).alias("prompts"), F.countDistinct("example_id").alias("ids"), F.count_if(valid).alias("valid"))
    return per.withColumn("repeated", F.col("prompts") - F.col("ids"))
