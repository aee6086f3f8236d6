"""Panels, multi-metric intervals and the remaining projections (the rest of inventory C to M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import canon
from sievewright.operators import selection, statistics
from sievewright.queries.registry import query
from sievewright.queries.statistics import _paired_by_group
from sievewright.queries.windows import GROUP, SHA
from sievewright.sources.tables import table


@query("""select coalesce(max_tokens, -1) as condition, count(*) as n, count_if(hit_token_limit) as limited, round(count_if(hit_token_limit) / count(*), 6) as share from candidates group by 1""")
def d25_rescore_by_condition(spark, d):
    return table(spark, d, "candidates").groupBy(F.coalesce("max_tokens", F.lit(-1)).alias("condition")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("hit_token_limit").alias("limited"), F.round(F.count_if("hit_token_limit") / F.count(F.lit(1)), 6).alias("share")
    )


@query("""select o_orderstatus as state, count(*) as n from orders group by 1""")
def d26_queue_states(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""select split, row_id from (select split, row_id, row_number() over (partition by split order by {SHA.format('example_id')}, row_id) as n from examples where split is not null and example_id is not null) where n <= 100""")
def f02_compound_order(spark, d):
    from sievewright.operators.windows import at_most

    rows = table(spark, d, "examples").filter("split is not null and example_id is not null")
    return at_most(rows, ["split"], [canon.digest_string("example_id"), F.col("row_id")], 100).select("split", "row_id")


@query("""with a as (select arm, sha256(string_agg(case_id, ',' order by case_id)) as ids, min(max_tokens) as m from (select distinct arm, case_id, max_tokens from candidates where arm is not null and case_id is not null) group by 1)
select x.arm as arm, y.arm as baseline, x.ids = y.ids and x.m = y.m as reusable from a x join a y on x.arm <> y.arm and y.arm = 'base'""")
def g13_reusable_baseline(spark, d):
    rows = table(spark, d, "candidates").filter("arm is not null and case_id is not null")
    # Sets of ids are compared by count and sum of hashes: no group is gathered.
    per = rows.select("arm", "case_id", "max_tokens").distinct().groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("case_id").cast("decimal(38,0)")).alias("ids"), F.min("max_tokens").alias("m")
    )
    base = per.filter("arm = 'base'").select(F.col("arm").alias("baseline"), F.col("n").alias("n2"), F.col("ids").alias("ids2"), F.col("m").alias("m2"))
    return per.filter("arm <> 'base'").join(base, F.col("arm") != F.col("baseline")).select("arm", "baseline", ((F.col("n") == F.col("n2")) & (F.col("ids") == F.col("ids2")) & (F.col("m") == F.col("m2"))).alias("reusable"))


@query()
def h04_release_panel(spark, d):
    """Of the first 400 held-out groups one row each, styles balanced, and all other rows in reserve."""
    rows = table(spark, d, "examples").filter("split = 'test' and example_id is not null and style is not null and source_group_id is not null")
    rank = canon.digest_list(F.lit("panel"), F.col("example_id"), F.col("row_id").cast("string"))
    ranked = rows.select(F.lower(F.trim("source_group_id")).alias("group"), F.col("row_id").alias("id"), "style", rank.alias("rank"))
    panel = spark.createDataFrame([(int(x), "panel") for x in selection.balanced_panel(ranked, 400)], "row_id long, sink string")
    return rows.select("row_id").join(F.broadcast(panel), "row_id", "left").select("row_id", F.coalesce("sink", F.lit("reserve")).alias("sink"))


@query()
def l02_several_metrics(spark, d):
    p = _paired_by_group(spark, d)
    both = statistics.class_bootstrap(p, "family", F.col("after") - F.col("before")).withColumn("metric", F.lit("whole"))
    kept = statistics.class_bootstrap(p, "family", F.col("after") * F.col("before")).withColumn("metric", F.lit("both"))
    return both.unionByName(kept)


@query()
def l03_panel_interval(spark, d):
    return statistics.class_bootstrap(_paired_by_group(spark, d), "family", F.col("after") - F.col("before"), seed=71)


@query()
def l04_wide_interval(spark, d):
    return statistics.class_bootstrap(_paired_by_group(spark, d), "family", F.col("after") - F.col("before"), seed=1709)


@query(f"""select {GROUP} as g, count(*) as n from examples where source_group_id is not null group by 1 order by n desc, g limit 20""")
def f_largest_families(spark, d):
    rows = table(spark, d, "examples").filter("source_group_id is not null").groupBy(F.lower(F.trim("source_group_id")).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "g").limit(20)
