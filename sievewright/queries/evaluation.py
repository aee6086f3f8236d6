"""Outputs of the arms held against their cases, over all arms (inventory D01, J14, K09 to K13, K17, K22, H18, C10, C27).

No table holds judgments or parses, so they are made from the data: a judge compares an output's rules text with its
target, a parser looks for balanced signs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions import schema, text
from sievewright.operators import evaluation
from sievewright.queries.registry import query
from sievewright.queries.text import KEY_SQL
from sievewright.sources.tables import table

_TEXT_FIELDS = "['name', 'mana_cost', 'type_line', 'power', 'toughness', 'loyalty', 'defense', 'hand_modifier', 'life_modifier', 'oracle_text', 'layout', 'rarity']"
_READ = rf"""j as (select *, coalesce(json_valid(raw) and not regexp_matches(raw, ',\s*[}}\]]'), false) as is_json, case when json_valid(raw) and not regexp_matches(raw, ',\s*[}}\]]') then try_cast(raw as json) end as v from candidates),
o as (select *, is_json and json_type(v) = 'OBJECT' as is_object from j),
r as (select *, is_object and list_has_all({_TEXT_FIELDS}, json_keys(v)) and list_has_all(json_keys(v), ['type_line', 'oracle_text']) and len(list_filter(json_keys(v), lambda k: json_type(v, '$.' || k) <> 'VARCHAR')) = 0
 and coalesce(v ->> '$.rarity', 'common') in ('common', 'uncommon', 'rare', 'mythic', 'special', 'bonus') as schema_valid,
 v ->> '$.name' as o_name, v ->> '$.rarity' as o_rarity, v ->> '$.type_line' as o_type_line, v ->> '$.mana_cost' as o_mana_cost, v ->> '$.power' as o_power, v ->> '$.toughness' as o_toughness, v ->> '$.oracle_text' as o_text from o),
cases as (select example_id as case_id, style, origin, description, target from (select *, row_number() over (partition by example_id order by row_id) as n from examples where split in ('validation', 'test') and example_id is not null) where n = 1),
outs as (select * from (select *, row_number() over (partition by arm, case_id order by candidate_id) as n from r where arm is not null and case_id is not null) where n = 1)"""
_PARSE = "case when {0} is null then 'parser_error' when length({0}) - length(replace({0}, '(', '')) = length({0}) - length(replace({0}, ')', '')) and length({0}) - length(replace({0}, '{{', '')) = length({0}) - length(replace({0}, '}}', '')) and length({0}) - length(replace({0}, '“', '')) = length({0}) - length(replace({0}, '”', '')) and trim({0}) <> '' then 'parsed' else 'rejected' end"
_WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+', 0))"
_STATED = "list_filter([" + ", ".join(f"{{f: '{f}', want: target.{f}, have: o_{f}}}" for f in evaluation.FIELDS[:-1]) + "], lambda e: coalesce(e.want <> '' and contains(lower(description), lower(e.want)), false))"
_KINDS = "string_split_regex(lower(string_split(coalesce(o_type_line, ''), '—')[1]), '\\s+')"
_ISSUES = f"""list_sort(list_distinct(list_filter(list_concat(list_transform({_STATED}, lambda e: case when e.have is null then 'explicit_' || e.f || '_missing' when e.have <> e.want then 'explicit_' || e.f || '_changed' end),
[case when trim(coalesce(o_name, '')) = '' then 'missing_name' end, case when list_contains({_KINDS}, 'creature') and trim(coalesce(o_power, '')) = '' then 'missing_power' end, case when list_contains({_KINDS}, 'creature') and trim(coalesce(o_toughness, '')) = '' then 'missing_toughness' end]), lambda x: x is not null)))"""
_JUDGED = f"""{_READ}, g as (select outs.*, style, origin, description, target, {_ISSUES} as issues from outs join cases using (case_id)),
q as (select *, case when coalesce(hit_token_limit, false) then 'truncated_generation' when not is_json then 'invalid_json' when not schema_valid then 'invalid_schema' when len(issues) > 0 then 'explicit_metadata_or_required_characteristic' else 'needs_intent_judge' end as gate0,
 case when not schema_valid then null when coalesce(target.oracle_text, '') = '' then 'uncertain' when len(list_intersect({_WORDS.format("coalesce(o_text, '')")}, {_WORDS.format('target.oracle_text')})) >= 0.3::double * len({_WORDS.format('target.oracle_text')}) then 'pass' else 'fail' end as verdict,
 case when hit_token_limit is null then 'low' else 'high' end as confidence, case when trim(coalesce(o_text, '')) = '' then 0 when contains(o_text, o_name) then 2 else 1 end as oracle_style,
 (o_mana_cost is distinct from target.mana_cost)::int + (o_type_line is distinct from target.type_line)::int + (o_power is distinct from target.power)::int + (o_toughness is distinct from target.toughness)::int + (len(string_split(coalesce(o_text, ''), chr(10))) <> len(string_split(coalesce(target.oracle_text, ''), chr(10))))::int as n_violations,
 {_PARSE.format('o_text')} as parse, {_PARSE.format('target.oracle_text')} as ref_parse from g),
s as (select *, case gate0 when 'explicit_metadata_or_required_characteristic' then -0.8::double when 'needs_intent_judge' then null else -1.0::double end as reward0 from q),
m as (select *, case when reward0 is not null then gate0 when verdict is null or confidence <> 'high' or verdict = 'uncertain' then 'judge_abstention' when verdict = 'pass' and n_violations > 0 then 'judge_inconsistent' when verdict = 'fail' then 'intent_failure' when oracle_style = 0 then 'unusable_rules'
 when parse = 'parser_error' or ref_parse = 'parser_error' then 'parser_infrastructure_failure' else 'faithful_candidate' end as gate from s),
w as (select *, case gate when 'intent_failure' then -0.6::double when 'unusable_rules' then -0.5::double when 'faithful_candidate' then round(0.75::double + 0.15::double * oracle_style / 2 + 0.10::double * case when ref_parse <> 'parsed' then 0.5 when parse = 'parsed' then 1.0 else 0.0 end, 6) else reward0 end as reward,
 coalesce(verdict = 'pass' and confidence = 'high' and oracle_style = 2 and n_violations = 0, false) as faithful, coalesce(verdict = 'fail' and confidence = 'high' and n_violations > 0, false) as wrong from m)"""


def _cases(spark, d) -> DataFrame:
    rows = table(spark, d, "examples").filter("split in ('validation', 'test')").withColumnRenamed("example_id", "case_id")
    return evaluation.first_per_key(rows, ["case_id"], "row_id", ["style", "origin", "description", "target"])


def _outputs(spark, d) -> DataFrame:
    """One output per arm and case, the first, read as a design."""
    first = evaluation.first_per_key(table(spark, d, "candidates"), ["arm", "case_id"], "candidate_id", ["candidate_id", "raw", "hit_token_limit"])
    return evaluation.read_outputs(first, "candidate_id", "raw")


def _judged(spark, d) -> DataFrame:
    """Outputs with their case, gate, judgment and reward."""
    rows = _outputs(spark, d).join(_cases(spark, d), "case_id")
    rows = rows.withColumn("issues", evaluation.violations(evaluation.stated(F.col("description")))).withColumns(evaluation.text_judgment())
    gate, reward = evaluation.output_gate(F.col("hit_token_limit"), F.col("issues"))
    rows = rows.withColumns({"gate0": gate, "reward0": reward, "parse": evaluation.balanced_text(F.col("oracle_text")), "ref_parse": evaluation.balanced_text(F.col("target.oracle_text"))})
    c = F.col
    gate, reward = evaluation.combine(c("gate0"), c("reward0"), c("verdict"), c("confidence"), c("oracle_style"), F.size("violations"), c("parse"), c("ref_parse"))
    return rows.withColumns({"gate": gate, "reward": reward, "faithful": evaluation.faithful(), "wrong": evaluation.wrong()})


@query(f"with {_READ} select candidate_id, is_json, is_object, schema_valid, case when is_json and schema_valid then '' end as schema_errors from r where raw is not null")
def j14_schema_checks(spark, d):
    """Every output that is not null: whether it is JSON, an object and a draft, and where it breaks the schema."""
    return schema.check_json(table(spark, d, "candidates"), "candidate_id", "raw")


@query(f"with {_JUDGED} select candidate_id, gate0 as gate, reward0 as reward, array_to_string(issues, ',') as issues from w")
def k09_gate_ladder(spark, d):
    return _judged(spark, d).select("candidate_id", F.col("gate0").alias("gate"), F.col("reward0").alias("reward"), F.array_join("issues", ",").alias("issues"))


@query(f"with {_JUDGED} select candidate_id, gate, reward from w")
def k10_reward_combine(spark, d):
    return _judged(spark, d).select("candidate_id", "gate", "reward")


@query(f"with {_JUDGED} select case_id, bool_and(reward is not null) and bool_or(gate = 'faithful_candidate') and min(reward) < max(reward) as usable from w group by 1")
def k11_group_usable(spark, d):
    return evaluation.usable_groups(_judged(spark, d), "case_id")


@query(f"with {_JUDGED} select candidate_id, faithful, wrong from w")
def k12_predicates(spark, d):
    return _judged(spark, d).select("candidate_id", "faithful", "wrong")


_DESIGN = "{0}name is not distinct from {1}name and {0}rarity is not distinct from {1}rarity and {0}type_line is not distinct from {1}type_line and {0}mana_cost is not distinct from {1}mana_cost and {0}power is not distinct from {1}power and {0}toughness is not distinct from {1}toughness"


@query(f"""with {_JUDGED}, b as (select case_id, o_name as b_name, o_rarity as b_rarity, o_type_line as b_type_line, o_mana_cost as b_mana_cost, o_power as b_power, o_toughness as b_toughness, o_text as b_text from w where arm = 'base'),
x as (select w.*, b.* exclude (case_id), b.b_text is null as unsupported from w join b using (case_id) where arm = 'repair'),
y as (select case_id, schema_valid, schema_valid and {_DESIGN.format('o_', 'target.')} as metadata, coalesce(verdict = 'pass' and n_violations = 0, false) as semantic, parse = 'parsed' and schema_valid as parsed, schema_valid and {_DESIGN.format('o_', 'b_')} and o_text is not distinct from b_text as unchanged, unsupported from x)
select case_id, schema_valid, metadata as metadata_preserved, semantic as semantics_preserved, parsed, unchanged, unsupported, schema_valid and metadata and semantic and (case when unsupported then unchanged else parsed end) as successful, unsupported and schema_valid and metadata and semantic and unchanged as unsupported_preserved from y""")
def k13_repair_matrix(spark, d):
    """Repairs against the design before (the base output of the case): a case without one is a control that must stay as it is."""
    rows = _judged(spark, d)
    fields = evaluation.FIELDS
    base = rows.filter("arm = 'base'").select("case_id", *(F.col(f).alias(f"b_{f}") for f in fields))
    x = rows.filter("arm = 'repair'").join(base, "case_id").withColumn("unsupported", F.col("b_oracle_text").isNull())
    same = lambda other, names: F.expr(" and ".join(f"{f} <=> {other}{f}" for f in names))
    x = x.withColumns({
        "metadata_preserved": F.col("schema_valid") & same("target.", fields[:-1]), "semantics_preserved": F.coalesce((F.col("verdict") == "pass") & (F.size("violations") == 0), F.lit(False)),
        "parsed": (F.col("parse") == "parsed") & F.col("schema_valid"), "unchanged": F.col("schema_valid") & same("b_", fields),
    })
    good = F.col("schema_valid") & F.col("metadata_preserved") & F.col("semantics_preserved")
    return x.select(
        "case_id", "schema_valid", "metadata_preserved", "semantics_preserved", "parsed", "unchanged", "unsupported",
        (good & F.when(F.col("unsupported"), F.col("unchanged")).otherwise(F.col("parsed"))).alias("successful"), (F.col("unsupported") & good & F.col("unchanged")).alias("unsupported_preserved"),
    )


@query(f"""with {_JUDGED}, a as (select arm from candidates where arm is not null group by 1), t as (select case_id, count(*) filter (verdict is not null) as verdicts, bool_or(coalesce(verdict = 'pass' and n_violations > 0, false)) as contradicts, bool_or(arm = 'teacher' and verdict = 'fail') as control_failed from w group by 1)
select case_id, (select count(*) from a) - verdicts as missing_labels, contradicts, coalesce(control_failed, false) as control_failed, verdicts = (select count(*) from a) and not contradicts and not coalesce(control_failed, false) as valid from t""")
def k17_reply_validity(spark, d):
    """Replies per case: a verdict for every arm, no pass with violations, and the known answer (the teacher's) not failed."""
    rows = _judged(spark, d)
    arms = table(spark, d, "candidates").filter("arm is not null").select("arm").distinct().count()
    per = rows.groupBy("case_id").agg(
        F.count("verdict").alias("verdicts"), F.bool_or(F.coalesce((F.col("verdict") == "pass") & (F.size("violations") > 0), F.lit(False))).alias("contradicts"),
        F.bool_or(F.coalesce((F.col("arm") == "teacher") & (F.col("verdict") == "fail"), F.lit(False))).alias("control_failed"),
    )
    missing = F.lit(arms).cast("long") - F.col("verdicts")
    return per.select("case_id", missing.alias("missing_labels"), "contradicts", "control_failed", ((missing == 0) & ~F.col("contradicts") & ~F.col("control_failed")).alias("valid"))


@query(f"""with {_JUDGED}, c as (select case_id, min(candidate_id) as chosen from w where faithful group by 1), x as (select case_id, min(candidate_id) as rejected from w where coalesce(verdict = 'fail' and confidence = 'high', false) group by 1) select c.case_id as case_id, chosen, rejected from c join x using (case_id)""")
def k22_pair_approval(spark, d):
    """Approved pairs: the chosen one passes with high confidence, full style and no violation, the rejected one fails with high confidence."""
    rows = _judged(spark, d)
    chosen = rows.filter("faithful").groupBy("case_id").agg(F.min("candidate_id").alias("chosen"))
    bad = F.coalesce((F.col("verdict") == "fail") & (F.col("confidence") == "high"), F.lit(False))
    return chosen.join(rows.filter(bad).groupBy("case_id").agg(F.min("candidate_id").alias("rejected")), "case_id")


@query(f"""with {_JUDGED}, x as (select * from w where arm <> 'teacher' and wrong), d as (select x.candidate_id, x.case_id from x join cases c on c.case_id = x.case_id where coalesce(c.target.oracle_text, '') <> '' and {KEY_SQL.format("coalesce(x.o_text, '')")} <> {KEY_SQL.format('c.target.oracle_text')})
select case_id, min(candidate_id) as rejected from d group by 1""")
def h18_reference_positive_pairs(spark, d):
    """The case's own target against its first wrong output of another content; the reference itself needs no judgment."""
    key = lambda c: text.description_key(F.coalesce(c, F.lit("")))
    rows = _judged(spark, d).filter("arm <> 'teacher' and wrong and coalesce(target.oracle_text, '') <> ''")
    other = rows.filter(key(F.col("oracle_text")) != key(F.col("target.oracle_text")))
    return other.groupBy("case_id").agg(F.min("candidate_id").alias("rejected"))


_SETS = ["()", "(style)", "(origin)", "(reference)"]


@query(f"""with {_READ}, c as (select *, case when coalesce(target.oracle_text, '') <> '' then 'rules text' else 'no rules text' end as reference from cases), t as (select style, origin, reference, count(*) as cases, grouping(style, origin, reference) as lv from c group by grouping sets ({', '.join(_SETS)})),
x as (select outs.arm, style, origin, reference, is_object, schema_valid, {_PARSE.format('o_text')} as parse, regexp_matches(o_text, '\\b[Ee]nters? the battlefield\\b') as rewritten, hit_token_limit, is_json from outs join c using (case_id)),
n as (select arm, style, origin, reference, grouping(style, origin, reference) as lv, count(*) as present, count_if(is_object) as json_objects, count_if(schema_valid) as schema_valid, count_if(schema_valid and parse = 'parsed') as accepted, count_if(schema_valid and parse in ('parsed', 'rejected')) as attempted,
 count_if(schema_valid and parse = 'parsed' and rewritten) as accepted_with_rewrites, count_if(hit_token_limit) as hit_token_limit, count_if(is_json) as generated, count_if(not is_json) as invalid_json from x group by grouping sets ({', '.join(s.replace('(', '(arm, ').replace(', )', ')') for s in _SETS)})),
g as (select a.arm, t.* from (select distinct arm from outs) a, t)
select g.arm as arm, g.style as style, g.origin as origin, g.reference as reference, cases, coalesce(json_objects, 0) as json_objects, coalesce(schema_valid, 0) as schema_valid, coalesce(accepted, 0) as accepted, coalesce(attempted, 0) as attempted, coalesce(accepted_with_rewrites, 0) as accepted_with_rewrites, coalesce(hit_token_limit, 0) as hit_token_limit,
 coalesce(generated, 0) as generated, coalesce(invalid_json, 0) as invalid_json, cases - coalesce(present, 0) as missing, round(coalesce(accepted, 0) / cases, 6) as rate_all, round(coalesce(accepted, 0) / nullif(coalesce(attempted, 0), 0), 6) as rate_attempted
from g left join n on n.arm = g.arm and n.lv = g.lv and n.style is not distinct from g.style and n.origin is not distinct from g.origin and n.reference is not distinct from g.reference""".replace("\\\\b", "\\b"))
def d01_eval_rollup(spark, d):
    """All arms over all cases, and by style, origin and whether the reference has rules text."""
    cases = _cases(spark, d).withColumn("reference", F.when(F.coalesce("target.oracle_text", F.lit("")) != "", "rules text").otherwise("no rules text")).drop("target", "description")
    outs = _outputs(spark, d).withColumns({
        "status": F.when(F.col("is_json"), "generated").otherwise("invalid_json"), "parse": evaluation.balanced_text(F.col("oracle_text")),
        "rewritten": F.size(text.normalize_wording(F.col("oracle_text"), text.WORDING_RULES[:1])[1]) > 0,
    })
    return evaluation.rollup(cases, outs.select("arm", "case_id", "status", "is_object", "schema_valid", "parse", "rewritten", "hit_token_limit"), [[], ["style"], ["origin"], ["reference"]])


@query(f"""with {_READ}, x as (select outs.arm, style, origin, schema_valid and {_PARSE.format('o_text')} = 'parsed' as accepted from outs join cases using (case_id))
select arm, style, origin, count(*) as outputs, count_if(accepted) as accepted, round(count_if(accepted) / count(*), 6) as rate from x group by grouping sets ((), (arm), (arm, style), (arm, origin))""")
def d02_grouping_sets(spark, d):
    rows = _outputs(spark, d).join(_cases(spark, d).select("case_id", "style", "origin"), "case_id")
    rows = rows.withColumn("accepted", F.col("schema_valid") & (evaluation.balanced_text(F.col("oracle_text")) == "parsed"))
    arm, style, origin = map(F.col, ("arm", "style", "origin"))
    return rows.groupingSets([[], [arm], [arm, style], [arm, origin]], arm, style, origin).agg(
        F.count(F.lit(1)).alias("outputs"), F.count_if("accepted").alias("accepted"), F.round(F.count_if("accepted") / F.count(F.lit(1)), 6).alias("rate")
    )


@query(f"""with {_READ}, p as (select arm, count(distinct case_id) as cases, min(max_tokens) as low, max(max_tokens) as high, count_if(is_object) as read, hash_sum from (select outs.*, null as hash_sum from outs) group by arm, hash_sum)
select x.arm as arm, y.arm as baseline, x.cases = y.cases as same_denominator, x.low is not distinct from y.low and x.high is not distinct from y.high as same_decoding, (x.read > 0) = (y.read > 0) as same_parser, x.cases = y.cases and x.low is not distinct from y.low and x.high is not distinct from y.high and (x.read > 0) = (y.read > 0) as compatible from p x, p y where x.arm < y.arm""")
def c10_identity_compatibility(spark, d):
    """Pairs of arms whose decoding limits, denominators and reading agree, null-safe: only such may be compared."""
    first = evaluation.first_per_key(table(spark, d, "candidates"), ["arm", "case_id"], "candidate_id", ["candidate_id", "raw", "max_tokens"])
    read = evaluation.read_outputs(first, "candidate_id", "raw")
    p = read.groupBy("arm").agg(F.count(F.lit(1)).alias("cases"), F.min("max_tokens").alias("low"), F.max("max_tokens").alias("high"), (F.count_if("is_object") > 0).alias("read"))
    other = p.select(*(F.col(c).alias(f"{c}_b") for c in p.columns))
    both = p.join(other, F.col("arm") < F.col("arm_b"))  # one row an arm
    parts = {"same_denominator": F.expr("cases = cases_b"), "same_decoding": F.expr("low <=> low_b and high <=> high_b"), "same_parser": F.expr("read = read_b")}
    every = F.lit(True)
    for e in parts.values():
        every = every & e
    return both.select("arm", F.col("arm_b").alias("baseline"), *(e.alias(k) for k, e in parts.items()), every.alias("compatible"))


@query(f"""with {_JUDGED}, k as (select case_id from cases), v as (select case_id, arm, verdict from w)
select 'unknown' as state, c.case_id as case_id, c.arm as arm from (select distinct case_id, arm from candidates where case_id is not null and arm is not null) c left join k using (case_id) where k.case_id is null
union all select 'unjudged', case_id, arm from v where verdict is null
union all select 'repeated', case_id, arm from candidates where case_id is not null and arm is not null group by 2, 3 having count(*) > 1""")
def c27_align_judgments(spark, d):
    """What breaks the alignment of judgments with cases: labels without a case, outputs without a verdict, repeated labels."""
    labels = table(spark, d, "candidates").filter("case_id is not null and arm is not null")
    counted = labels.groupBy("case_id", "arm").agg(F.count(F.lit(1)).alias("n"))
    unknown = counted.join(_cases(spark, d).select("case_id"), "case_id", "left_anti").select(F.lit("unknown").alias("state"), "case_id", "arm")
    unjudged = _judged(spark, d).filter("verdict is null").select(F.lit("unjudged").alias("state"), "case_id", "arm")
    return unknown.unionByName(unjudged).unionByName(counted.filter("n > 1").select(F.lit("repeated").alias("state"), "case_id", "arm"))
