"""Quality gates and filters (inventory K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.operators import gates
from sievewright.queries.registry import query
from sievewright.sources.tables import table


@query("""select card_no, case when layout in ('saga', 'adventure') then 'excluded_layout' when type_line is null then 'no_type' when oracle_text is null and coalesce(len(card_faces), 0) = 0 then 'no_text' else 'kept' end as route from cards""")
def k01_layout_routing(spark, d):
    route = F.when(F.col("layout").isin("saga", "adventure"), "excluded_layout").when(F.col("type_line").isNull(), "no_type")
    route = route.when(F.col("oracle_text").isNull() & (F.coalesce(F.size("card_faces"), F.lit(0)) <= 0), "no_text").otherwise("kept")
    return table(spark, d, "cards").select("card_no", route.alias("route"))


@query("""select row_id, 'no_description' as violation from examples where coalesce(description, '') = '' union all select row_id, 'no_split' from examples where split is null""")
def k06_release_violations(spark, d):
    codes = gates.issues({"no_description": F.coalesce("description", F.lit("")) == "", "no_split": F.col("split").isNull()})
    return table(spark, d, "examples").select("row_id", F.explode(codes).alias("violation"))


@query("""select card_id, case when validation is null then 'needs_review' when validation.parse_complete and coalesce(draft.oracle_text, '') <> '' then 'accepted' when coalesce(draft.oracle_text, '') = '' then 'skip' else 'pending' end as state from custom_cards""")
def k07_triage(spark, d):
    blank = F.coalesce("draft.oracle_text", F.lit("")) == ""
    done = F.coalesce("validation.parse_complete", F.lit(False))
    state = F.when(F.col("validation").isNull(), "needs_review").when(done & ~blank, "accepted").when(blank, "skip").otherwise("pending")
    return table(spark, d, "custom_cards").select("card_id", state.alias("state"))


@query("""select e.row_id, c.card_no, e.target.rarity is not distinct from c.rarity and e.target.power is not distinct from c.power and e.target.toughness is not distinct from c.toughness as preserved from examples e join cards c on e.source.oracle_id = c.oracle_id""")
def k14_metadata_preserved(spark, d):
    rows = table(spark, d, "examples").select("row_id", "target", F.col("source.oracle_id").alias("oracle_id"))
    cards = table(spark, d, "cards").select("card_no", "oracle_id", "rarity", "power", "toughness")
    same = F.lit(True)
    for c in ("rarity", "power", "toughness"):
        same = same & F.col(f"target.{c}").eqNullSafe(F.col(c))
    return rows.join(cards, "oracle_id").select("row_id", "card_no", same.alias("preserved"))


@query("""select style, count(*) as n, count(*) >= 100 as enough from examples where split = 'test' group by 1""")
def k16_minimum_coverage(spark, d):
    return table(spark, d, "examples").filter("split = 'test'").groupBy("style").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= 100).alias("enough"))


@query("""select doc_id from documents where length(text) between 200 and 1800""")
def k18_length_filter(spark, d):
    return table(spark, d, "documents").filter(F.length("text").between(200, 1800)).select("doc_id")


@query("""with b as (select candidate_id, arm, output_tokens, false as control from candidates where arm is not null union all select c.id, a.arm, c.t, true from (select distinct arm from candidates where arm is not null) a, (values (-1, 10), (-2, 300)) as c(id, t))
select arm, count(*) as n, bool_and(case when control then (output_tokens > 128) = (candidate_id = -2) else true end) as trusted from b group by 1""")
def k19_control_rows(spark, d):
    rows = table(spark, d, "candidates").filter("arm is not null").select("candidate_id", "arm", "output_tokens")
    controls = spark.createDataFrame([(-1, 10), (-2, 300)], "candidate_id long, output_tokens int")
    judged = gates.with_controls(rows, "arm", controls).withColumn("verdict", F.col("output_tokens") > 128)
    size = judged.groupBy("arm").agg(F.count(F.lit(1)).alias("n"))
    return size.join(gates.trusted_batches(judged, "arm", F.col("verdict"), F.col("candidate_id") == -2), "arm").select("arm", "n", "trusted")


@query("""select distinct example_id from examples where split = 'train' and example_id is not null""")
def k20_scope_filter(spark, d):
    return table(spark, d, "examples").filter("split = 'train' and example_id is not null").select("example_id").distinct()
