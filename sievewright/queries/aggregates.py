"""Aggregations (inventory D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import text
from sievewright.operators import aggregates
from sievewright.queries.registry import query
from sievewright.sources.tables import table

@query("""select arm, count(*) as n, count_if(raw is null or raw = '') as blank, count_if(hit_token_limit) as limited, round(avg(output_tokens), 6) as mean_tokens from candidates group by 1""")
def d03_assay_rollup(spark, d):
    return table(spark, d, "candidates").groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("raw is null or raw = ''")).alias("blank"), F.count_if("hit_token_limit").alias("limited"), F.round(F.avg("output_tokens"), 6).alias("mean_tokens"))


@query("""select rarity, layout, count(*) as n from cards group by grouping sets ((rarity), (layout), (rarity, layout))""")
def d04_breakdowns(spark, d):
    return table(spark, d, "cards").groupingSets([[F.col("rarity")], [F.col("layout")], [F.col("rarity"), F.col("layout")]], F.col("rarity"), F.col("layout")).agg(F.count(F.lit(1)).alias("n"))


_FEATURES = "with f as (select card_no, oracle_id, unnest(list_filter([" + ", ".join(f"case when regexp_matches(oracle_text, '{p.replace(chr(39), chr(39) * 2)}') then 'pattern:{k}' end" for k, p in text.FEATURE_PATTERNS.items()) + "], lambda x: x is not null)) as feature from cards)"


@query("""select style as feature, count(distinct source_group_id) as total, count(distinct case when split = 'train' then source_group_id end) as train, count(distinct case when split in ('validation', 'test') then source_group_id end) as held_out from examples where style is not null group by 1""")
def d07_coverage_by_side(spark, d):
    of = lambda cond: F.countDistinct(F.when(F.expr(cond), F.col("source_group_id")))
    rows = table(spark, d, "examples").filter("style is not null")
    return rows.groupBy(F.col("style").alias("feature")).agg(F.countDistinct("source_group_id").alias("total"), of("split = 'train'").alias("train"), of("split in ('validation', 'test')").alias("held_out"))


_REASONS = "list_filter([case when raw is null or raw = '' then 'blank' end, case when hit_token_limit then 'limit' end, case when output_tokens > max_tokens * 0.9 then 'long' end, case when not regexp_matches(raw, '^\\s*\\{') then 'not_object' end], lambda x: x is not null)".replace("\\\\", "\\")


def _reasons():
    return F.array_compact(F.array(
        F.when(F.expr("raw is null or raw = ''"), "blank"), F.when(F.col("hit_token_limit"), "limit"), F.when(F.col("output_tokens") > F.col("max_tokens") * F.lit(0.9), "long"), F.when(~F.col("raw").rlike(r"^\s*\{"), "not_object")
    ))


@query(f"with r as (select unnest({_REASONS}) as reason from candidates) select reason, count(*) as n from r group by 1")
def d08_reason_histogram(spark, d):
    return table(spark, d, "candidates").select(F.explode(_reasons()).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"select array_to_string({_REASONS}, '+') as combination, count(*) as n from candidates group by 1")
def d09_reason_combinations(spark, d):
    return table(spark, d, "candidates").groupBy(F.array_join(_reasons(), "+").alias("combination")).agg(F.count(F.lit(1)).alias("n"))


@query("""select arm, count_if(raw like '{%') as objects, count_if(raw like '```%') as fenced, count_if(raw = '') as empty, count_if(raw is null) as absent, count_if(hit_token_limit) as limited, count_if(hit_token_limit is null) as unflagged, count_if(output_tokens = max_tokens) as full_length, count(*) as n from candidates group by 1""")
def d10_metric_counters(spark, d):
    flags = {"objects": "raw like '{%'", "fenced": "raw like '```%'", "empty": "raw = ''", "absent": "raw is null", "limited": "hit_token_limit", "unflagged": "hit_token_limit is null", "full_length": "output_tokens = max_tokens"}
    return table(spark, d, "candidates").groupBy("arm").agg(*(F.count_if(F.expr(e)).alias(k) for k, e in flags.items()), F.count(F.lit(1)).alias("n"))


@query("""select case when hit_token_limit is null then 'abstain' when hit_token_limit then 'cut' else 'whole' end as verdict, case when regexp_matches(raw, '[.}`]\\s*$') then 'whole' else 'cut' end as expected, count(*) as n from candidates where raw <> '' group by 1, 2""".replace("\\\\", "\\"))
def d11_confusion_abstain(spark, d):
    verdict = F.when(F.col("hit_token_limit").isNull(), "abstain").when(F.col("hit_token_limit"), "cut").otherwise("whole")
    expected = F.when(F.col("raw").rlike(r"[.}`]\s*$"), "whole").otherwise("cut")
    return table(spark, d, "candidates").filter("raw <> ''").groupBy(verdict.alias("verdict"), expected.alias("expected")).agg(F.count(F.lit(1)).alias("n"))


@query("""select event_type, min(value) as low, max(value) as high, count_if(value > 0.9) as above from events where value is not null group by 1""")
def d12_range_and_threshold(spark, d):
    return table(spark, d, "events").filter("value is not null").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.expr("value > 0.9")).alias("above"))


@query("""with m as (select event_type, unnest(json_keys(props)) as key, props from events where props is not null) select event_type, key, sum(cast(json_extract_string(props, '$.' || key) as double)) as total from m group by 1, 2""")
def d13_map_sum(spark, d):
    rows = table(spark, d, "events").filter("props is not null").select("event_type", F.from_json("props", "map<string,double>").alias("m"))
    return aggregates.map_sums(rows, ["event_type"], "m")


@query("""select split, count(distinct source_group_id) as groups, count(distinct source.oracle_id) as cards, count(distinct example_id) as examples from examples group by 1""")
def d16_distinct_cardinality(spark, d):
    return table(spark, d, "examples").groupBy("split").agg(F.countDistinct("source_group_id").alias("groups"), F.countDistinct("source.oracle_id").alias("cards"), F.countDistinct("example_id").alias("examples"))


@query("""select case_id, count(*) as errors from candidates where hit_token_limit or raw is null or raw = '' group by 1""")
def d19_errors_per_case(spark, d):
    return table(spark, d, "candidates").filter("hit_token_limit or raw is null or raw = ''").groupBy("case_id").agg(F.count(F.lit(1)).alias("errors"))


@query("""select style, count_if(origin = 'official') as official, count_if(origin = 'custom') as custom, count_if(origin = 'repair') as repair, count_if(origin = 'replay') as replay from examples group by 1""")
def d20_pivot(spark, d):
    names = ["official", "custom", "repair", "replay"]
    return table(spark, d, "examples").groupBy("style").pivot("origin", names).agg(F.count(F.lit(1))).fillna(0, names)


@query("""select sha256(raw) as content, coalesce(bool_or(hit_token_limit) and bool_or(not hit_token_limit), false) as contradictory, count(*) as n from candidates where raw <> '' group by 1 having count(*) > 1""")
def d21_contradiction_sets(spark, d):
    rows = table(spark, d, "candidates").filter("raw <> ''")
    both = F.bool_or("hit_token_limit") & F.bool_or(~F.col("hit_token_limit"))
    return rows.groupBy(F.sha2("raw", 256).alias("content")).agg(F.coalesce(both, F.lit(False)).alias("contradictory"), F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("""with a as (select case_id, bool_or(arm = 'base' and not coalesce(hit_token_limit, false)) as before, bool_or(arm = 'sft' and not coalesce(hit_token_limit, false)) as after from candidates where case_id is not null group by 1)
select count_if(after and not before) as gained, count_if(before and not after) as lost, count_if(before and after) as kept from a""")
def d22_transitions(spark, d):
    ok = lambda arm: F.bool_or((F.coalesce("arm", F.lit("")) == arm) & ~F.coalesce("hit_token_limit", F.lit(False)))
    a = table(spark, d, "candidates").filter("case_id is not null").groupBy("case_id").agg(ok("base").alias("before"), ok("sft").alias("after"))
    return a.agg(F.count_if(F.expr("after and not before")).alias("gained"), F.count_if(F.expr("before and not after")).alias("lost"), F.count_if(F.expr("before and after")).alias("kept"))


@query("""with k as (select 'group' as kind, source_group_id as key, split from examples union all select 'card', source.oracle_id, split from examples union all select 'description', sha256(description), split from examples where description <> ''),
x as (select kind, key from k where key is not null and split is not null group by 1, 2 having count(distinct split) > 1) select kind, count(*) as overlapping from x group by 1""")
def d23_overlap_metrics(spark, d):
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in (("group", F.col("source_group_id")), ("card", F.col("source.oracle_id")), ("description", F.when(F.col("description") != "", F.sha2("description", 256))))))
    rows = table(spark, d, "examples").filter("split is not null").select("split", F.explode(keys).alias("k")).select("split", "k.kind", "k.key").filter("key is not null")
    per = rows.groupBy("kind", "key").agg(F.countDistinct("split").alias("splits")).filter("splits > 1")
    return per.groupBy("kind").agg(F.count(F.lit(1)).alias("overlapping"))


@query("""select case when raw is null then 'absent' when raw = '' then 'empty' when case_id is null then 'no_case' when hit_token_limit then 'limit' else 'kept' end as skip_reason, count(*) as n from candidates group by 1""")
def d24_skip_reasons(spark, d):
    reason = F.when(F.col("raw").isNull(), "absent").when(F.col("raw") == "", "empty").when(F.col("case_id").isNull(), "no_case").when(F.col("hit_token_limit"), "limit").otherwise("kept")
    return table(spark, d, "candidates").groupBy(reason.alias("skip_reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def d_pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(revenue), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))
