"""Cards as drafts of their faces, families, features and tasks (inventory H01, H02, H14, D06, I05, I08, I15, I22, I25, J01 to J06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import canon, text
from sievewright.operators import projection
from sievewright.queries.registry import query
from sievewright.queries.text import BARE_SQL, STRIP_SQL
from sievewright.sources.tables import table


def _bound(x: str, own: str, other: str, alias: str) -> str:
    """SQL for a text with the own name and that of one other face replaced, clauses after `named` kept."""
    rep = f"replace(replace(replace({{0}}, coalesce(nullif({own}, ''), chr(3)), 'CARDNAME'), coalesce(nullif(string_split({own}, ',')[1], ''), chr(3)), 'CARDNAME'), coalesce(nullif({other}, ''), chr(3)), {alias})"
    part = f"case when contains(p, chr(2)) then string_split(p, chr(2))[1] || {rep.format('string_split(p, chr(2))[2]')} else {rep.format('p')} end"
    return rf"array_to_string(list_transform(string_split(regexp_replace({x}, '(\bnamed\s+[^.\n;]+)', chr(1) || '\1' || chr(2), 'g'), chr(1)), lambda p: {part}), '')"


_RAW = "coalesce(x, '')"
_BARE = f"(case when not regexp_matches({BARE_SQL.format(_RAW)}, '[()]') then {STRIP_SQL.format(BARE_SQL.format(_RAW))} else {_RAW} end)"
# One row per face: the record's own fields where it has none.
_SIDES = f"""f0 as (select card_no, oracle_id, layout, type_line as whole_type, coalesce(len(card_faces), 0) as faces, coalesce(len(card_faces), 0) > 0 as many, name as own_name, colors as own_colors,
 case when len(card_faces) > 0 then list_transform(card_faces, lambda f, i: {{face: i - 1, name: f.name, t: f.type_line, cost: f.mana_cost, c: coalesce(f.colors, colors), p: f.power, q: f.toughness, x: f.oracle_text}}) else [{{face: 0, name: name, t: type_line, cost: mana_cost, c: colors, p: power, q: toughness, x: oracle_text}}] end as s from cards),
f1 as (select * exclude (s), s as all_sides, unnest(s) as s from f0),
f2 as (select * exclude (s), s.face::int as face, s.name as name, s.t as t, s.cost as cost, s.p as p, s.q as q, s.x as x, coalesce(s.c, case when regexp_matches(coalesce(s.x, ''), '(?m)^Devoid\\b') then [] else list_filter(['W', 'U', 'B', 'R', 'G'], lambda c: contains(coalesce(s.cost, ''), c)) end) as c0, all_sides[case when s.face = 0 then 2 else 1 end].name as other, 'Draft Face ' || case when s.face = 0 then '2' else '1' end as other_alias from f1),
f3 as (select *, list_filter(['W', 'U', 'B', 'R', 'G'], lambda c: list_contains(c0, c)) as colors, {_BARE} as bare from f2),
f4 as (select *, {_bound('bare', "coalesce(name, '')", 'other', 'other_alias')} as rules from f3)""".replace("\\\\b", "\\b")
_FAMILY = rf"""{_SIDES}, g0 as (select card_no, max(case when many then coalesce(layout, 'normal') else 'single' end) as l, string_agg(rules, chr(10) || 'FACE' || chr(10) order by face) as t from f4 group by 1),
g1 as (select card_no, l, trim(regexp_replace(lower(regexp_replace(regexp_replace(t, '\{{[^}}]+\}}|[0-9]+|\b(?:one|two|three|four|five|six|seven|eight|nine|ten)\b', '#', 'g'), '\b(?:white|blue|black|red|green)\b', 'COLOR', 'g')), '\s+', ' ', 'g')) as t from g0),
fam as (select card_no, sha256('[' || to_json(l)::varchar || ', ' || to_json(t)::varchar || ']') as family from g1)"""
_PATTERN = "case when regexp_matches(x, '{1}') then 'pattern:{0}' end"
_PATTERNS = ", ".join(_PATTERN.format(k, p.replace("'", "''")) for k, p in text.FEATURE_PATTERNS.items())
_TYPES = ", ".join(f"'{t}'" for t in text.CARD_TYPES)
_FEATURES = f"""{_FAMILY}, u1 as (select card_no, list_distinct(flatten(list(coalesce(all_c, [])))) as cs from (select card_no, case when many then coalesce(s_c, []) else coalesce(own_colors, []) end as all_c from (select *, all_sides[face + 1].c as s_c from f4)) group by 1),
u2 as (select card_no, list_filter(['W', 'U', 'B', 'R', 'G'], lambda c: list_contains(cs, c)) as cs from u1),
e as (select card_no, 'layout:' || coalesce(layout, 'normal') as feature from f4 union select card_no, unnest(list_filter([{_PATTERNS}], lambda v: v is not null)) from f4
 union select card_no, 'type:' || w from (select card_no, unnest(string_split_regex(lower(string_split(t, '—')[1]), '\\s+')) as w from f4) where w in ({_TYPES})
 union select card_no, 'color:' || unnest(cs) from u2 union select card_no, 'color_bucket:' || case when len(cs) = 0 then 'colorless' when len(cs) > 1 then 'multicolor' else cs[1] end from u2
 union select card_no, 'color_combination:' || case when len(cs) = 0 then 'C' else array_to_string(cs, '') end from u2)""".replace("\\\\s", "\\s")


def _cards(spark, d):
    return table(spark, d, "cards")


def card_features(df, keep: list[str]):
    """(`keep`, `feature`) of every side of each card; colours are those of all its sides."""
    rows = df.select(*keep, "layout", projection.sides().alias("_s"))
    colors = F.array_distinct(F.flatten(F.transform("_s", lambda s: F.coalesce(s["colors"], F.array().cast("array<string>")))))
    each = rows.withColumn("_c", colors).select(*keep, "layout", "_c", F.explode("_s").alias("s"))
    return each.select(*keep, F.explode(text.features(F.col("layout"), F.col("s.type_line"), F.col("s.oracle_text"), F.col("_c"))).alias("feature")).distinct()


# The card types that a design's coverage counts.
COVERED_TYPES = ["Creature", "Instant", "Sorcery", "Artifact", "Enchantment", "Land", "Planeswalker", "Battle"]


def design_coverage(draft: str = "draft"):
    """Sorted features of a design for covering: its colours (or none, or several) and its types."""
    none = F.array().cast("array<string>")
    colors = F.coalesce(F.col(f"{draft}.colors"), none)
    tagged = F.transform(colors, lambda c: F.concat(F.lit("color:"), c))
    kinds = F.filter(F.split(F.split(F.coalesce(f"{draft}.type_line", F.lit("")), "—")[0], r"\s+"), lambda t: t.isin(COVERED_TYPES))
    more = F.array_compact(F.array(F.when(F.size(colors) == 0, "color:colorless"), F.when(F.size(colors) > 1, "color:multicolor")))
    return F.array_sort(F.array_distinct(F.concat(tagged, more, F.transform(kinds, lambda t: F.concat(F.lit("type:"), t)))))


_COVERED = "['" + "', '".join(COVERED_TYPES) + "']"


@query(f"""select card_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(list_transform(coalesce(draft.colors, []), lambda c: 'color:' || c), [case when len(coalesce(draft.colors, [])) = 0 then 'color:colorless' end, case when len(draft.colors) > 1 then 'color:multicolor' end],
list_transform(list_filter(string_split_regex(string_split(coalesce(draft.type_line, ''), '—')[1], '[ ]+'), lambda t: list_contains({_COVERED}, t)), lambda t: 'type:' || t)), lambda v: v is not null))), ',') as coverage from custom_cards""")
def h15_candidate_coverage(spark, d):
    return table(spark, d, "custom_cards").select("card_id", F.array_join(design_coverage(), ",").alias("coverage"))


@query(f"with {_FAMILY} select card_no, family from fam")
def h01_family_digest(spark, d):
    return _cards(spark, d).select("card_no", projection.family().alias("family"))


@query(f"with {_FAMILY} select card_no, case ('0x' || substr(family, 1, 8))::bigint % 10 when 0 then 'test' when 1 then 'validation' else 'train' end as split from fam")
def h02_hash_split(spark, d):
    h = canon.hash_bucket(F.col("family"), 10)
    split = F.when(h == 0, "test").when(h == 1, "validation").otherwise("train")
    return h01_family_digest(spark, d).select("card_no", split.alias("split"))


@query(f"with {_FEATURES} select card_no, string_agg(feature, ',' order by feature) as features from e group by 1")
def h14_feature_extraction(spark, d):
    made = card_features(_cards(spark, d), ["card_no"])
    return made.groupBy("card_no").agg(F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("features"))  # bounded by the kinds of features


@query(f"with {_FEATURES} select feature, count(*) as cards, count(distinct family) as families from e join fam using (card_no) group by 1")
def d06_feature_totals(spark, d):
    """All features; families are counted by first collapsing (feature, family)."""
    rows = _cards(spark, d).withColumn("family", projection.family())
    per = card_features(rows, ["card_no", "family"]).groupBy("feature", "family").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("feature").agg(F.sum("n").alias("cards"), F.count(F.lit(1)).alias("families"))


@query(f"with c as (select card_no, {_bound('oracle_text', 'name', 'null', chr(39) * 2)} as rules from cards) select * from c")
def i05_self_reference(spark, d):
    return _cards(spark, d).select("card_no", text.bind_names(F.col("oracle_text"), F.col("name")).alias("rules"))


_RULE_SQL = {n: (p, r.replace("$1", "\\1").replace("$2", "\\2")) for n, p, r in text.WORDING_RULES if p}
_WORDING = f"{_SIDES}, w0 as (select card_no, face, t, name, x as t0 from f4 where x is not null)"
for _i, (_n, _p, _r) in enumerate(text.WORDING_RULES):
    if _p:
        _step = f"regexp_replace(t{_i}, '{_p}', '{_RULE_SQL[_n][1]}', 'g')"
    else:
        _lines = f"string_split(t{_i}, chr(10))"
        _depth = f"len(regexp_replace(array_to_string({_lines}[1:i - 1], ''), '[^\"“”]', '', 'g')) % 2 = 0"
        _change = f"list_transform({_lines}, lambda l, i: case when starts_with(l, 'As long as ' || name || ' is renowned,') and {_depth} then 'As long as this creature is renowned,' || substr(l, len('As long as ' || name || ' is renowned,') + 1) else l end)"
        _step = f"case when coalesce(list_contains(string_split(string_split(t, '—')[1], ' '), 'Creature') and name <> '', false) then array_to_string({_change}, chr(10)) else t{_i} end"
    _WORDING += f", w{_i + 1} as (select *, {_step} as t{_i + 1} from w{_i})"
_CHANGED = ", ".join(f"case when t{i + 1} <> t{i} then '{n}' end" for i, (n, _, _) in enumerate(text.WORDING_RULES))


@query(f"with {_WORDING} select card_no, face, sha256(t{len(text.WORDING_RULES)}) as text_hash, array_to_string(list_filter([{_CHANGED}], lambda v: v is not null), ',') as rules from w{len(text.WORDING_RULES)}")
def i08_wording_rules(spark, d):
    """All rules in order, per face with rules text."""
    each = _cards(spark, d).select("card_no", F.posexplode(projection.sides()).alias("face", "s")).filter("s.oracle_text is not null")
    after, rules = text.normalize_wording(F.col("s.oracle_text"), text.WORDING_RULES, F.col("s.name"), F.col("s.type_line"))
    return each.select("card_no", "face", F.sha2(after, 256).alias("text_hash"), F.array_join(rules, ",").alias("rules"))


@query(f"with {_SIDES}, n as (select card_no, face, replace(replace(replace(rules, 'CARDNAME', coalesce(name, 'Draft Card')), 'Draft Face 1', coalesce(all_sides[1].name, '')), 'Draft Face 2', coalesce(all_sides[2].name, '')) as bound from f4 where many) select * from n")
def i15_bind_face_names(spark, d):
    """Drafted faces with the placeholders of all faces bound to names again."""
    rows = _cards(spark, d).filter("size(card_faces) > 0").withColumn("names", F.transform("card_faces", lambda f: F.coalesce(f["name"], F.lit(""))))
    each = projection.drafts(rows, ["card_no", "names"])
    return each.select("card_no", "face", projection.bound_back(F.col("rules"), F.col("name"), F.col("names")).alias("bound"))


@query(f"with {_SIDES} select card_no, face, rules from f4 where many")
def i25_normalized_faces(spark, d):
    return projection.drafts(_cards(spark, d).filter("size(card_faces) > 0"), ["card_no"]).select("card_no", "face", "rules")


@query(f"with {_SIDES} select card_no, face, case when many then 'Draft Face ' || (face + 1) end as draft_name, t as type_line, cost as mana_cost, array_to_string(colors, '') as colors, p as power, q as toughness, sha256(rules) as rules_hash, case when many or coalesce(layout, 'normal') <> 'normal' then layout end as layout from f4")
def j01_faces_to_draft(spark, d):
    layout = F.when((F.col("faces") > 0) | (F.coalesce("layout", F.lit("normal")) != "normal"), F.col("layout"))
    return projection.drafts(_cards(spark, d), ["card_no"]).select(
        "card_no", "face", "draft_name", "type_line", "mana_cost", F.array_join("colors", "").alias("colors"), "power", "toughness", F.sha2("rules", 256).alias("rules_hash"), layout.alias("layout")
    )


_CORRUPT = " union all ".join(f"select card_no, {i} as o, '{k}' as kind, rules, regexp_replace(rules, '{p}', '{r.replace('$2', chr(92) + '1')}') as made from f4 where face = 0" for i, (k, p, r) in enumerate(text.CORRUPTIONS))


@query(f"with {_SIDES}, k as ({_CORRUPT} union all select card_no, 99, 'short_self_reference', rules, case when contains(name, ' ') and not contains(name, ',') then replace(rules, 'CARDNAME', string_split(name, ' ')[1]) end from f4 where face = 0) select card_no, kind, sha256(made) as text_hash from k where made <> rules")
def i22_corruptions(spark, d):
    """Every corruption that changes the drafted rules text of the first side."""
    rows = projection.drafts(_cards(spark, d), ["card_no"]).filter("face = 0")
    made = rows.select("card_no", F.explode(text.corruptions(F.col("rules"), F.col("name"))).alias("c"))
    return made.select("card_no", "c.kind", F.sha2("c.text", 256).alias("text_hash"))


_V = r"case when list_has_any(regexp_extract_all(cost, '\{([^}]+)\}', 1), ['X', 'Y', 'Z']) then 3 else coalesce(list_sum(list_transform(regexp_extract_all(cost, '\{([^}]+)\}', 1), lambda s: coalesce(list_max(list_transform(string_split(s, '/'), lambda z: try_cast(z as integer))), 1))), 0)::int end"
_PATHS = "list_filter([{0}], lambda v: v is not null)"
_HAVE = ", ".join(f"case when {c} is not null then '{n}' end" for c, n in (("cost", "mana_cost"), ("p", "power"), ("q", "toughness")))
_PROJECT = rf"""{_SIDES}, a as (select *, row_number() over (partition by card_no order by face) = 1 as first, bool_or(rules <> '') over (partition by card_no) as has_rules from f4 where oracle_id is not null),
b as (select *, regexp_matches(coalesce(p, ''), '^-?[0-9]+$') and regexp_matches(coalesce(q, ''), '^-?[0-9]+$') as fixed, regexp_matches(coalesce(p, ''), '^[0-9]+$') and regexp_matches(coalesce(q, ''), '^[0-9]+$') as sized,
 array_to_string(list_filter(string_split_regex(string_split(coalesce(t, ''), ' — ')[1], ' +'), lambda w: w not in ('Legendary', 'Snow', 'World', 'Basic', '')), ' ') as broad, case when contains(t, ' — ') then substr(t, strpos(t, ' — ') + 3) end as rest from a where first),
c as (select *, case when contains(broad, 'Creature') and rest is not null then broad || ' — ' || rest else broad end as short, case when sized then case when greatest(p::int, q::int) <= 2 then 'small' when greatest(p::int, q::int) <= 4 then 'midsize' else 'large' end end as note, many or coalesce(layout, 'normal') <> 'normal' as lay from b),
d as (select *, flatten(list_transform(all_sides, lambda s: list_transform(list_filter(['name', case when s.t is not null then 'type_line' end, case when s.cost is not null then 'mana_cost' end, case when s.p is not null then 'power' end, case when s.q is not null then 'toughness' end, 'colors', 'oracle_text'], lambda v: v is not null), lambda f: 'card_faces.' || s.face || '.' || f))) as side_paths,
 flatten(list_transform(all_sides, lambda s: list_transform(['name', 'type_line', 'oracle_text'], lambda f: 'card_faces.' || s.face || '.' || f))) as mech_paths from c),
e as (select *, case when many then list_concat(['layout', 'type_line', 'oracle_text'], side_paths) else {_PATHS.format("case when t is not null then 'type_line' end, " + _HAVE + ", 'colors', 'oracle_text', case when lay then 'layout' end")} end as whole, {_PATHS.format("'type_line', " + _HAVE + ", 'colors', 'oracle_text'")} as sparse from d),
l as (select *, unnest(['minimal', 'concept', 'mechanics', 'complete', 'casual_complete']) as style from e),
m as (select *, style in ('minimal', 'concept') as thin, case style when 'minimal' then {_PATHS.format("'type_line', 'oracle_text', case when fixed then 'power' end, case when fixed then 'toughness' end")} when 'concept' then {_PATHS.format("'type_line', 'colors', 'oracle_text', case when note is not null then 'design_notes' end")}
 when 'mechanics' then case when many then list_concat(['layout', 'type_line', 'oracle_text'], mech_paths) else {_PATHS.format("'type_line', 'oracle_text', case when lay then 'layout' end")} end else whole end as stated,
 case when style = 'concept' and note is not null then list_append(sparse, 'design_notes') when style in ('minimal', 'concept') then sparse else whole end as target,
 list_filter(['W', 'U', 'B', 'R', 'G'], lambda z: contains(coalesce(cost, ''), z)) as own from l),
n as (select *, case when (case when thin then '' else rules end) = '' and len(colors) = 0 and len(own) > 0 then case when not list_contains(stated, 'colors') then 'colors' when not list_contains(stated, 'mana_cost') then 'mana_cost' end end as adjusted from m),
pr as (select card_no, style, substr(sha256('["levels-1", ' || to_json(oracle_id)::varchar || ', "' || style || '"]'), 1, 24) as id, case when thin then short when many then whole_type else t end as type_line, case when thin then '' else rules end as rules, case adjusted when 'colors' then own else colors end as colors,
 case adjusted when 'mana_cost' then '{{' || {_V} || '}}' else cost end as mana_cost, case when thin and p is not null and not fixed then '3' else p end as power, case when thin and p is not null and not fixed then '3' else q end as toughness, case when style = 'concept' then note end as note, adjusted, colors as colors_before, cost as cost_before,
 case when thin then 'unspecified' when has_rules then 'all' else 'explicit_none' end as rules_coverage, list_sort(stated) as specified, list_sort(list_filter(list_distinct(target), lambda v: not list_contains(stated, v))) as proposed, list_filter(['mana_cost', 'type_line', 'colors', 'power', 'toughness', 'loyalty', 'defense', 'hand_modifier', 'life_modifier'], lambda v: not list_contains(stated, v)) as omitted from n)"""


def _projected(spark, d):
    return projection.projections(_cards(spark, d).filter("oracle_id is not null"), "oracle_id", "levels-1", ["card_no"])


@query(f"with {_PROJECT} select card_no, style, id, type_line, sha256(rules) as rules_hash, power, toughness, note, rules_coverage, array_to_string(specified, ',') as specified, array_to_string(proposed, ',') as proposed, array_to_string(omitted, ',') as omitted from pr")
def j02_detail_levels(spark, d):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return _projected(spark, d).select("card_no", "style", "id", "type_line", F.sha2("rules", 256).alias("rules_hash"), "power", "toughness", "note", "rules_coverage", *map(joined, ("specified", "proposed", "omitted")))


@query(f"""with {_PROJECT}, x as (select card_no, unnest(['broad_plain', 'broad_shorthand']) as style, type_line, rules from pr where style = 'complete')
select x.card_no as card_no, style, substr(sha256('["broad-1", ' || to_json(oracle_id)::varchar || ', "' || style || '"]'), 1, 24) as id, x.type_line as reference_type, sha256(rules) as reference_rules, 'summary' as rules_coverage from x join cards c on c.card_no = x.card_no""")
def j03_broad_tasks(spark, d):
    """Two broad tasks per card, whose reference is the draft of the complete level."""
    names = _cards(spark, d).select("card_no", "oracle_id")
    rows = _projected(spark, d).filter("style = 'complete'").select("card_no", "type_line", "rules").join(names, "card_no")
    rows = rows.select("*", F.explode(F.array(F.lit("broad_plain"), F.lit("broad_shorthand"))).alias("style"))
    new = F.substring(canon.digest_list(F.lit("broad-1"), F.col("oracle_id"), F.col("style")), 1, 24)
    return rows.select("card_no", "style", new.alias("id"), F.col("type_line").alias("reference_type"), F.sha2("rules", 256).alias("reference_rules"), F.lit("summary").alias("rules_coverage"))


@query(f"with {_PROJECT} select card_no, style, array_to_string(colors, '') as colors, mana_cost, adjusted from pr where style in ('minimal', 'concept')")
def j05_sparse_defaults(spark, d):
    """Colours and cost of the sparse levels after coherent defaults, and which of them was changed."""
    return _projected(spark, d).filter("style in ('minimal', 'concept')").select("card_no", "style", F.array_join("colors", "").alias("colors"), "mana_cost", "adjusted")


@query(f"with {_PROJECT} select card_no, style, array_to_string(colors_before, '') as colors_before, cost_before, array_to_string(colors, '') as colors, mana_cost, adjusted from pr")
def j06_adjust_and_keep(spark, d):
    """Every record with what it was before its adjustment, if any."""
    joined = lambda c: F.array_join(c, "").alias(c)
    return _projected(spark, d).select("card_no", "style", joined("colors_before"), "cost_before", joined("colors"), "mana_cost", "adjusted")
