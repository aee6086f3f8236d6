"""Text and structure: normalisation keys, rewriting, projections (inventory I and J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import canon, text
from sievewright.queries.registry import query
from sievewright.sources.tables import table

KEY_SQL = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_{{}}/*+\-]+', ' ', 'g'))"
WORDS_SQL = r"array_to_string(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+', 0), ' ')"
BARE_SQL = "regexp_replace(" * 4 + "{0}" + r", '\([^()]*\)', '', 'g')" * 4
STRIP_SQL = r"regexp_replace(regexp_replace({0}, '[ \t\r]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"select row_id, {KEY_SQL.format('description')} as key from examples")
def i01_description_key(spark, d):
    return table(spark, d, "examples").select("row_id", text.description_key(F.col("description")).alias("key"))


@query(r"select doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) as key from documents")
def i02_whitespace_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.whitespace_key(F.col("text")), 256).alias("key"))


@query()
def i03_compatibility_key(spark, d):
    return table(spark, d, "cards").select("card_no", text.compatibility_key(F.col("name")).alias("key"))


@query(rf"""with b as (select card_no, {BARE_SQL.format('oracle_text')} as t from cards)
select card_no, case when t is not null and not regexp_matches(t, '[()]') then {STRIP_SQL.format('t')} end as bare from b""")
def i04_without_reminder(spark, d):
    return table(spark, d, "cards").select("card_no", text.without_parentheses(F.col("oracle_text")).alias("bare"))


@query(rf"""with b as (select card_no, type_line, {BARE_SQL.format('oracle_text')} as t from cards),
s0 as (select card_no, lower(type_line) as ty, lower(translate({STRIP_SQL.format('t')}, '−’“”', '-''""')) as t from b where not regexp_matches(t, '[()]')),
{''.join(f"s{i + 1} as (select card_no, ty, case when contains(ty, '{k}') then replace(t, 'this {k}', 'cardname') else t end as t from s{i})," for i, k in enumerate(text.SELF_TYPES))}
m as (select card_no, {'replace(' * len(text.MODERN)}t{''.join(f", '{a}', '{b}')" for a, b in text.MODERN)} as t from s{len(text.SELF_TYPES)}),
r as (select card_no, regexp_replace(regexp_replace(regexp_replace(t, '[^\p{{L}}\p{{N}}_{{}}/*+\-.,:;!?"''\n]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), ' +([.,:;!?])', '\1', 'g') as t from m)
select card_no, sha256(trim(t)) as signature from r""")
def i06_signature(spark, d):
    sig = text.wording_signature(F.col("oracle_text"), F.col("type_line"))
    return table(spark, d, "cards").select("card_no", F.sha2(sig, 256).alias("signature")).filter("signature is not null")


@query(r"""with a as (select doc_id, text as before, regexp_replace(text, '\b([Mm]et) (a|an)\b', '\1', 'g') as after from documents)
select doc_id, sha256(before) as before_hash, sha256(after) as after_hash from a where before <> after""")
def i07_modernize_with_diff(spark, d):
    after = F.regexp_replace("text", r"\b([Mm]et) (a|an)\b", "$1")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("before"), after.alias("after")).filter("before <> after")
    return docs.select("doc_id", F.sha2("before", 256).alias("before_hash"), F.sha2("after", 256).alias("after_hash"))


@query(r"""with base as (select distinct name from cards where name is not null),
x as (select card_id, draft.name as name, regexp_replace(draft.name, ' (of|the) [^ ]+$', '') as stripped from custom_cards)
select card_id, case when b.name is not null then x.stripped else x.name end as name from x left join base b on b.name = x.stripped""")
def i09_suffix_if_known(spark, d):
    base = table(spark, d, "cards").select(F.col("name").alias("known")).filter("known is not null").distinct()
    x = table(spark, d, "custom_cards").select("card_id", "draft.name", F.regexp_replace("draft.name", " (of|the) [^ ]+$", "").alias("stripped"))
    return x.join(base, F.col("stripped") == F.col("known"), "left").select("card_id", F.when(F.col("known").isNotNull(), F.col("stripped")).otherwise(F.col("name")).alias("name"))


@query(rf"""select card_id, sha256(coalesce({KEY_SQL.format('draft.type_line')}, '') || '|' || coalesce(draft.mana_cost, '') || '|' || coalesce(draft.power, '') || '|' || coalesce(draft.toughness, '') || '|' || coalesce({KEY_SQL.format('draft.oracle_text')}, '')) as key from custom_cards""")
def i10_mechanical_key(spark, d):
    c = lambda x: F.coalesce(x, F.lit(""))
    parts = [c(text.description_key(F.col("draft.type_line"))), c(F.col("draft.mana_cost")), c(F.col("draft.power")), c(F.col("draft.toughness")), c(text.description_key(F.col("draft.oracle_text")))]
    return table(spark, d, "custom_cards").select("card_id", F.sha2(F.concat_ws("|", *parts), 256).alias("key"))


@query(r"""select wording_id, sha256(regexp_extract(record, '"name"\s*:\s*"', 0) || regexp_replace(record, '"name"\s*:\s*"([^"\\]|\\.)*"', '"name":"#"')) as key from printed_wordings where regexp_matches(record, '"name"\s*:\s*"')""")
def i11_masked_structure_key(spark, d):
    head = r'"name"\s*:\s*"'
    rows = table(spark, d, "printed_wordings").filter(F.col("record").rlike(head))
    masked = F.regexp_replace("record", head + r'([^"\\]|\\.)*"', '"name":"#"')
    return rows.select("wording_id", F.sha2(F.concat(F.regexp_extract("record", head, 0), masked), 256).alias("key"))


@query(f"select row_id, sha256({WORDS_SQL.format('description')}) as words from examples")
def i12_words(spark, d):
    return table(spark, d, "examples").select("row_id", F.sha2(text.words(F.col("description")), 256).alias("words"))


@query(rf"""with x as (select row_id, {WORDS_SQL.format('description')} as w, lower(regexp_extract(target.type_line, '([\p{{L}}]+)$', 1)) as kind from examples)
select row_id, kind, contains(' ' || w || ' ', ' ' || kind || ' ') or contains(' ' || w || ' ', ' ' || kind || 's ') or contains(' ' || w || ' ', ' ' || kind || 'es ') or contains(' ' || w || ' ', ' ' || regexp_replace(kind, 'y$', 'ies') || ' ') as is_mentioned
from x where w is not null and kind <> ''""")
def i13_type_word_mentioned(spark, d):
    kind = F.lower(F.regexp_extract("target.type_line", r"([\p{L}]+)$", 1))
    x = table(spark, d, "examples").select("row_id", text.words(F.col("description")).alias("w"), kind.alias("kind")).filter("w is not null and kind <> ''")
    return x.select("row_id", "kind", text.mentioned(F.col("kind"), F.col("w")).alias("is_mentioned"))


@query(r"""select row_id, array_to_string(regexp_extract_all(description, '(?:\{[0-9A-Z/]+\})+', 0), ' ') as costs, array_to_string(regexp_extract_all(description, '[0-9]+/[0-9]+', 0), ' ') as stats from examples where description is not null""")
def i14_symbol_extractors(spark, d):
    every = lambda p: F.array_join(F.regexp_extract_all("description", F.lit(p), F.lit(0)), " ")
    return table(spark, d, "examples").filter("description is not null").select("row_id", every(r"(?:\{[0-9A-Z/]+\})+").alias("costs"), every("[0-9]+/[0-9]+").alias("stats"))


@query("""select card_no, sha256(case when len(card_faces) > 0 then array_to_string(list_transform(card_faces, lambda f: concat_ws(chr(10), f.name, f.mana_cost, f.type_line, f.oracle_text)), chr(10) || '//' || chr(10))
else concat_ws(chr(10), name, mana_cost, type_line, oracle_text) end) as document from cards""")
def i18_render_document(spark, d):
    faces = F.transform("card_faces", lambda f: F.concat_ws("\n", f["name"], f["mana_cost"], f["type_line"], f["oracle_text"]))
    whole = F.when(F.size("card_faces") > 0, F.array_join(faces, "\n//\n")).otherwise(F.concat_ws("\n", "name", "mana_cost", "type_line", "oracle_text"))
    return table(spark, d, "cards").select("card_no", F.sha2(whole, 256).alias("document"))


@query("""select row_id, concat_ws('; ', 'Name: ' || target.name, 'Cost: ' || target.mana_cost, 'Type: ' || target.type_line, 'Stats: ' || target.power || '/' || target.toughness) as label from examples""")
def i19_render_description(spark, d):
    t = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    stats = F.concat(F.lit("Stats: "), F.col("target.power"), F.lit("/"), F.col("target.toughness"))
    return table(spark, d, "examples").select("row_id", F.concat_ws("; ", t("Name", F.col("target.name")), t("Cost", F.col("target.mana_cost")), t("Type", F.col("target.type_line")), stats).alias("label"))


@query("""select card_no, array_to_string(list_filter(['W','U','B','R','G'], lambda c: contains(mana_cost, c)), '') as colors from cards where mana_cost is not null""")
def i20_colors_of_cost(spark, d):
    return table(spark, d, "cards").filter("mana_cost is not null").select("card_no", F.array_join(text.colors_of(F.col("mana_cost")), "").alias("colors"))


@query("""select card_no, trim(string_split(type_line, '—')[1]) as card_type, case when len(colors) = 0 then 'colorless' when len(colors) > 1 then 'multicolor' else colors[1] end as color_group from cards where type_line is not null and colors is not null""")
def i21_type_and_color_labels(spark, d):
    n = F.size("colors")
    group = F.when(n == 0, "colorless").when(n > 1, "multicolor").otherwise(F.get("colors", F.lit(0)))
    return table(spark, d, "cards").filter("type_line is not null and colors is not null").select("card_no", F.trim(F.split("type_line", "—")[0]).alias("card_type"), group.alias("color_group"))


@query("""select card_no, 'power_edit' as kind, cast(cast(power as bigint) + 1 as varchar) as value from cards where contains(type_line, 'Creature') and regexp_full_match(power, '[0-9]+')
union all select card_no, 'loyalty_edit', cast(cast(loyalty as bigint) + 1 as varchar) from cards where contains(type_line, 'Planeswalker') and regexp_full_match(loyalty, '[0-9]+')
union all select card_no, 'keyword_edit', 'Flying' || case when oracle_text <> '' then chr(10) || oracle_text else '' end from cards where contains(type_line, 'Creature') and not regexp_matches(coalesce(oracle_text, ''), '(?i)\\bflying\\b')""".replace("\\\\b", "\\b"))
def i23_edits(spark, d):
    digits, plus = "^[0-9]+$", lambda c: (F.col(c).try_cast("long") + 1).cast("string")
    creature = F.contains(F.col("type_line"), F.lit("Creature"))
    flying = F.concat(F.lit("Flying"), F.when(F.col("oracle_text") != "", F.concat(F.lit("\n"), F.col("oracle_text"))).otherwise(""))
    edit = lambda cond, kind, value: F.when(cond, F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    every = F.array_compact(F.array(
        edit(creature & F.col("power").rlike(digits), "power_edit", plus("power")),
        edit(F.contains(F.col("type_line"), F.lit("Planeswalker")) & F.col("loyalty").rlike(digits), "loyalty_edit", plus("loyalty")),
        edit(creature & ~F.coalesce("oracle_text", F.lit("")).rlike(r"(?i)\bflying\b"), "keyword_edit", flying),
    ))
    return table(spark, d, "cards").select("card_no", F.explode(every).alias("e")).select("card_no", "e.kind", "e.value")


@query("""select row_id, array_to_string(list_filter([case when target.name is not null then 'name' end, case when target.rarity is not null then 'rarity' end, case when target.type_line is not null then 'type_line' end, case when target.oracle_text is not null then 'oracle_text' end, case when target.power is not null then 'power' end, case when target.toughness is not null then 'toughness' end, case when target.mana_cost is not null then 'mana_cost' end], lambda x: x is not null), ',') as paths from examples""")
def j04_leaf_paths(spark, d):
    names = ["name", "rarity", "type_line", "oracle_text", "power", "toughness", "mana_cost"]
    return table(spark, d, "examples").select("row_id", F.array_join(F.array_compact(F.array(*(F.when(F.col(f"target.{n}").isNotNull(), F.lit(n)) for n in names))), ",").alias("paths"))


@query("""select row_id, sha256('{' || concat_ws(',', '"type_line":' || to_json(target.type_line)::varchar, '"oracle_text":' || to_json(target.oracle_text)::varchar) || '}') as design from examples where target.type_line is not null""")
def j07_allow_list_without_nulls(spark, d):
    design = F.to_json(F.struct("target.type_line", "target.oracle_text"))
    return table(spark, d, "examples").filter("target.type_line is not null").select("row_id", F.sha2(design, 256).alias("design"))


@query("""select row_id, substr(sha256('["names-1", ' || to_json(example_id)::varchar || ', ' || to_json(target.name)::varchar || ']'), 1, 24) as new_id from examples where example_id is not null and target.name is not null""")
def j11_enriched_identity(spark, d):
    rows = table(spark, d, "examples").filter("example_id is not null and target.name is not null")
    return rows.select("row_id", F.substring(canon.digest_list(F.lit("names-1"), F.col("example_id"), F.col("target.name")), 1, 24).alias("new_id"))


@query("""with e as (select row_id, description, unnest([{f: 'name', v: target.name}, {f: 'mana_cost', v: target.mana_cost}, {f: 'rarity', v: target.rarity}]) as c from examples)
select row_id, c.f as field, c.v as value from e where c.v <> '' and contains(lower(description), lower(c.v))""")
def j12_literal_evidence(spark, d):
    claims = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"target.{f}").alias("value")) for f in ("name", "mana_cost", "rarity")))
    rows = table(spark, d, "examples").select("row_id", "description", F.explode(claims).alias("c"))
    return rows.filter("c.value <> '' and contains(lower(description), lower(c.value))").select("row_id", "c.field", "c.value")

