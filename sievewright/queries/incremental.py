"""Batch twins of the incremental steps, sinks' receipts and the composite pipeline (inventory M, B, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import text
from sievewright.plans.release import release
from sievewright.queries.registry import query
from sievewright.queries.text import KEY_SQL
from sievewright.sources import sinks
from sievewright.sources.tables import table
from sievewright.streaming import incremental


@query("""select candidate_id, arm from candidates where case_id is not null and case_id not in (select example_id from examples where split = 'validation' and example_id is not null)""")
def m02_incremental_refresh(spark, d):
    seen = table(spark, d, "examples").filter("split = 'validation' and example_id is not null").select(F.col("example_id").alias("case_id"))
    return table(spark, d, "candidates").filter("case_id is not null").join(seen, "case_id", "left_anti").select("candidate_id", "arm")


@query("""with g as (select distinct case_id from candidates where case_id is not null), s as (select case_id, row_number() over (partition by case_id order by candidate_id) - 1 as slot from candidates where case_id is not null)
select g.case_id as case_id, cast(k as integer) as slot from g, (select unnest(range(4)) as k) where not exists (select 1 from s where s.case_id = g.case_id and s.slot = k)""")
def m06_resume_grid(spark, d):
    rows = table(spark, d, "candidates").filter("case_id is not null")
    done = rows.selectExpr("case_id", "row_number() over (partition by case_id order by candidate_id) - 1 as slot")
    return incremental.missing_slots(rows, done, "case_id", 4)


@query("""with r as (select event_id, user_id, round(sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 6) as reserved from events) select event_id, reserved, reserved > 5 as over_limit from r""")
def m10_budget_ledger(spark, d):
    return incremental.running_budget(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", "reserved", "over_limit")


@query("""select time_bucket(interval '1 hour', ts) as hour, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2""")
def m_tumbling_hours(spark, d):
    rows = table(spark, d, "events")
    per = incremental.tumbling(rows, "ts", "1 hour", "1 hour", ["event_type"], "value")
    return per.select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""select example_id, min(split) as split, min(split) <> max(split) as conflict from examples where example_id is not null and split is not null group by 1""")
def b06_split_map(spark, d):
    return sinks.key_map(table(spark, d, "examples").filter("split is not null"), "example_id", "split")


_JSON = "'{' || concat_ws(',', " + ", ".join(f"""'"{f}":' || to_json({f})::varchar""" for f in ("name", "type_line", "oracle_text", "mana_cost")) + ") || '}'"
_NAME = " || ' ' || ".join(f"{p}[(h // {16**i}) % 16 + 1]" for i, p in enumerate(text.PARTS))


@query(f"""with k as (select row_id, {KEY_SQL.format('description')} as key, example_id, split, target, description from examples where description <> '' and split is not null),
r as (select *, row_number() over (partition by key order by case split when 'test' then 0 when 'validation' then 1 else 2 end, example_id nulls first, row_id) as n from k),
h as (select *, ('0x' || substr(sha256(to_json(example_id)::varchar), 1, 8))::bigint as h from r where n = 1),
e as (select row_id, split, coalesce(target.rarity, 'none') as rarity, description, case when h % 4 = 0 then {_NAME} else target.name end as name, target.type_line as type_line, target.oracle_text as oracle_text, target.mana_cost as mana_cost from h)
select row_id, split, rarity, coalesce(name, '') <> '' and coalesce(type_line, '') <> '' and oracle_text is not null as valid, description as prompt, {_JSON} as completion from e""")
def n11_release_pipeline(spark, d):
    """Names, rarity, deduplication, validation and export of the examples in one lazy plan."""
    return release(table(spark, d, "examples"))


@query(f"""with k as (select doc_id, lower(trim(lang)) as lang, {KEY_SQL.format('text')} as key from documents where text is not null), f as (select key, arg_min(lang, doc_id) as lang0, min(doc_id) as doc_id from k group by 1), g as (select f.key, k.lang from f join k on k.doc_id = f.doc_id)
select case ('0x' || substr(sha256(to_json(key)::varchar), 1, 8))::bigint % 10 when 0 then 'test' when 1 then 'validation' else 'train' end as split, lang, count(*) as n from g group by 1, 2""")
def minimum_slice(spark, d):
    from sievewright.plans.release import minimum_slice as plan

    return plan(table(spark, d, "documents"))
