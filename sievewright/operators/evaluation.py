"""Outputs held against their cases: JSON and schema, stated fields, judgments, rewards and roll-ups (inventory D01, K09 to K22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.schema import DRAFT, check_json
from sievewright.operators.aggregates import rate

FIELDS = ("name", "rarity", "type_line", "mana_cost", "power", "toughness", "oracle_text")


def first_per_key(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The row of each key with the smallest `order`; keys with a null part are left out."""
    rows = df.filter(" and ".join(f"{k} is not null" for k in keys))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in columns))


def read_outputs(df: DataFrame, key: str, raw: str, schema: dict = DRAFT) -> DataFrame:
    """Every row of `df` with `is_json`, `is_object`, `schema_valid` and the text fields of its design; a null output is no JSON."""
    made = check_json(df, key, raw, schema, FIELDS)
    read = df.join(made, key, "left")
    return read.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_json", "is_object", "schema_valid")})


def stated(description: Column, target: str = "target", fields: tuple[str, ...] = FIELDS[:-1]) -> Column:
    """The fields of a case whose wanted value its description states literally, as an array of (field, value)."""
    every = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{target}.{f}").alias("value")) for f in fields))
    return F.filter(every, lambda e: (e["value"] != "") & F.contains(F.lower(description), F.lower(e["value"])))


def violations(stated_fields: Column) -> Column:
    """Sorted codes of stated fields that a design lacks or has otherwise, and of what its type requires and it has not."""
    have = F.create_map(*(x for f in FIELDS[:-1] for x in (F.lit(f), F.col(f))))
    told = F.transform(
        F.coalesce(stated_fields, F.array().cast("array<struct<field:string,value:string>>")),
        lambda e: F.when(have[e["field"]].isNull(), F.concat(F.lit("explicit_"), e["field"], F.lit("_missing"))).when(have[e["field"]] != e["value"], F.concat(F.lit("explicit_"), e["field"], F.lit("_changed"))),
    )
    kinds = F.split(F.lower(F.split(F.coalesce("type_line", F.lit("")), "—")[0]), r"\s+")
    lacks = lambda kind, field: F.when(F.array_contains(kinds, kind) & (F.trim(F.coalesce(field, F.lit(""))) == ""), F.lit(f"missing_{field}"))
    needed = F.array(F.when(F.trim(F.coalesce("name", F.lit(""))) == "", F.lit("missing_name")), lacks("creature", "power"), lacks("creature", "toughness"))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(told, needed))))


def output_gate(truncated: Column, issues: Column) -> tuple[Column, Column]:
    """(gate, reward) before any judgment, for rows of `read_outputs`; a reward of null waits for a judgment."""
    steps = [
        ("truncated_generation", F.coalesce(truncated, F.lit(False)), -1.0),
        ("invalid_json", ~F.col("is_json"), -1.0),
        ("invalid_schema", ~F.col("schema_valid"), -1.0),
        ("explicit_metadata_or_required_characteristic", F.size(issues) > 0, -0.8),
    ]
    gate, reward = F.lit("needs_intent_judge"), F.lit(None).cast("double")
    for name, condition, value in reversed(steps):
        gate, reward = F.when(condition, name).otherwise(gate), F.when(condition, value).otherwise(reward)
    return gate, reward


def combine(gate: Column, reward: Column, verdict: Column, confidence: Column, style: Column, n_violations: Column, parse: Column, reference_parse: Column) -> tuple[Column, Column]:
    """(gate, reward) after a judgment; what is decided stays, and null is no reward, not a neutral one.

    The syntax term is 1 or 0 as the output parses where the reference does, else 0.5; a failure of the parser itself is no
    evidence. A judgment that passes with violations contradicts itself.
    """
    syntax = F.when(F.coalesce(reference_parse, F.lit("")) != "parsed", 0.5).when(parse == "parsed", 1.0).otherwise(0.0)
    full = F.round(F.lit(0.75) + F.lit(0.15) * style / 2 + F.lit(0.10) * syntax, 6)
    abstains = verdict.isNull() | (F.coalesce(confidence, F.lit("")) != "high") | (verdict == "uncertain")
    failed = (F.coalesce(parse, F.lit("")) == "parser_error") | (F.coalesce(reference_parse, F.lit("")) == "parser_error")
    ladder = [
        (reward.isNotNull(), gate, reward),
        (abstains, F.lit("judge_abstention"), F.lit(None)),
        ((verdict == "pass") & (n_violations > 0), F.lit("judge_inconsistent"), F.lit(None)),
        (verdict == "fail", F.lit("intent_failure"), F.lit(-0.6)),
        (style == 0, F.lit("unusable_rules"), F.lit(-0.5)),
        (failed, F.lit("parser_infrastructure_failure"), F.lit(None)),
    ]
    out_gate, out_reward = F.lit("faithful_candidate"), full
    for condition, g, r in reversed(ladder):
        out_gate, out_reward = F.when(condition, g).otherwise(out_gate), F.when(condition, r.cast("double")).otherwise(out_reward)
    return out_gate, out_reward


def usable_groups(df: DataFrame, group: str, gate: str = "gate", reward: str = "reward") -> DataFrame:
    """(`group`, `usable`): all rewards known, a faithful candidate among them, and two that differ."""
    known, good = F.bool_and(F.col(reward).isNotNull()), F.bool_or(F.col(gate) == "faithful_candidate")
    return df.groupBy(group).agg((known & good & (F.min(reward) < F.max(reward))).alias("usable"))


def balanced_text(rules: Column) -> Column:
    """A stand-in for a parser's status: null text is an error of the parser, text with unbalanced signs is rejected."""
    n = lambda sign: F.length(rules) - F.length(F.replace(rules, F.lit(sign)))
    even = (n("(") == n(")")) & (n("{") == n("}")) & (n("“") == n("”"))
    return F.when(rules.isNull(), "parser_error").when(even & (F.trim(rules) != ""), "parsed").otherwise("rejected")


def text_judgment(share: float = 0.3) -> dict[str, Column]:
    """A stand-in for a judge, from a design's fields and `target`: verdict, confidence, oracle_style and violations.

    It passes rules text that has at least `share` of the target's distinct words; violations are changed fields, and another
    number of lines.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    lines = lambda c: F.size(F.split(c, "\n"))
    own, wanted = F.coalesce("oracle_text", F.lit("")), F.col("target.oracle_text")
    enough = F.size(F.array_intersect(words(own), words(wanted))) >= F.lit(share) * F.size(words(wanted))
    verdict = F.when(~F.col("schema_valid"), None).when(F.coalesce(wanted, F.lit("")) == "", "uncertain").when(enough, "pass").otherwise("fail")
    changed = [F.when(~F.col(f).eqNullSafe(F.col(f"target.{f}")), F.lit(f)) for f in ("mana_cost", "type_line", "power", "toughness")]
    changed.append(F.when(lines(own) != lines(F.coalesce(wanted, F.lit(""))), F.lit("lines")))
    style = F.when(F.trim(own) == "", 0).when(F.contains("oracle_text", "name"), 2).otherwise(1)
    return {"verdict": verdict, "confidence": F.when(F.col("hit_token_limit").isNull(), "low").otherwise("high"), "oracle_style": style, "violations": F.array_compact(F.array(*changed))}


def faithful() -> Column:
    return F.coalesce((F.col("verdict") == "pass") & (F.col("confidence") == "high") & (F.col("oracle_style") == 2) & (F.size("violations") == 0), F.lit(False))


def wrong() -> Column:
    return F.coalesce((F.col("verdict") == "fail") & (F.col("confidence") == "high") & (F.size("violations") > 0), F.lit(False))


def rollup(cases: DataFrame, outcomes: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Per arm and each set of case columns: counts, statuses, and acceptance over all cases and over those attempted.

    `cases`: `case_id` once each, with the columns of `sets`; `outcomes`: at most one row per arm and case, with `arm`,
    `status`, `is_object`, `schema_valid`, `parse`, `rewritten`, `hit_token_limit`. Cases without an outcome are counted as
    missing from the totals of their group, so the grid of arms and cases is never made. A rate without a base is null.
    """
    by = sorted({c for s in sets for c in s})
    grouped = lambda df, extra: df.groupingSets([[*map(F.col, extra + s)] for s in sets], *map(F.col, extra + by))
    accepted = F.col("schema_valid") & (F.col("parse") == "parsed")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counted = {
        "present": F.count(F.lit(1)), "json_objects": n(F.col("is_object")), "schema_valid": n(F.col("schema_valid")), "accepted": n(accepted),
        "attempted": n(F.col("schema_valid") & F.col("parse").isin("parsed", "rejected")), "accepted_with_rewrites": n(accepted & F.col("rewritten")),
        "hit_token_limit": n(F.col("hit_token_limit")), "generated": n(F.col("status") == "generated"), "invalid_json": n(F.col("status") == "invalid_json"),
    }
    level = F.grouping_id().alias("_level")
    total = grouped(cases, []).agg(level, F.count(F.lit(1)).alias("cases"))
    arms = outcomes.select("arm").distinct()
    seen = grouped(outcomes.join(cases.select("case_id", *by), "case_id"), ["arm"]).agg(level, *(e.alias(k) for k, e in counted.items()))
    grid = arms.crossJoin(total)  # groups, not cases
    right = seen.withColumnsRenamed({c: f"_{c}" for c in ["arm", "_level", *by]})
    on = (F.col("arm") == F.col("_arm")) & (F.col("_level") == F.col("__level"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    every = grid.join(right, on, "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in counted})
    return every.select(
        "arm", *by, "cases", *(k for k in counted if k != "present"), (F.col("cases") - F.col("present")).alias("missing"),
        rate(F.col("accepted"), F.col("cases")).alias("rate_all"), rate(F.col("accepted"), F.col("attempted")).alias("rate_attempted"),
    )
