"""Contracts, remaining projections and samples (the rest of inventory A to M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import canon
from sievewright.operators import contracts
from sievewright.operators.windows import hash_ranks
from sievewright.queries.registry import query
from sievewright.queries.windows import SHA
from sievewright.sources.tables import table


@query(" union all ".join(f"select row_id, '{s}' as read_from from examples where split = '{s}'" for s in ("train", "validation", "test")))
def a02_splits_in_order(spark, d):
    rows = table(spark, d, "examples")
    parts = [rows.filter(F.col("split") == s).select("row_id", F.lit(s).alias("read_from")) for s in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""select vec_id, len(embedding) = 64 as right_size, round(sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))), 6) as norm from embeddings""")
def a10_vector_shape(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", (F.size("embedding") == 64).alias("right_size"), F.round(norm, 6).alias("norm"))


@query("""select example_id, count(*) as n from examples where example_id is not null group by 1 having count(*) > 1""")
def a16_unique_overlay_keys(spark, d):
    from sievewright.operators.joins import repeated_keys

    return repeated_keys(table(spark, d, "examples").filter("example_id is not null"), "example_id")


@query("""select arm, count(*) as receipts, count(distinct case_id) as cases, count(*) = count(distinct case_id) as complete from candidates where arm is not null group by 1""")
def a17_complete_predictions(spark, d):
    n, m = F.count(F.lit(1)), F.countDistinct("case_id")
    return table(spark, d, "candidates").filter("arm is not null").groupBy("arm").agg(n.alias("receipts"), m.alias("cases"), (n == m).alias("complete"))


@query("""with a as (select distinct example_id as k from examples where split = 'validation' and example_id is not null), n as (select case_id as k, count(*) as n from candidates where arm = 'sft' and case_id is not null group by 1)
select coalesce(a.k, n.k) as case_id, case when n.k is null then 'missing' when a.k is null then 'unknown' else 'repeated' end as state from a full join n on a.k = n.k where a.k is null or n.k is null or n.n > 1""")
def c26_align_replies(spark, d):
    asked = table(spark, d, "examples").filter("split = 'validation' and example_id is not null").select(F.col("example_id").alias("case_id"))
    return contracts.align_replies(asked, table(spark, d, "candidates").filter("arm = 'sft' and case_id is not null"), "case_id")


@query(f"""select row_id, row_number() over (partition by split, style order by {SHA.format('example_id')}, row_id) as place from examples where example_id is not null""")
def f01_hash_shuffle(spark, d):
    rows = table(spark, d, "examples").filter("example_id is not null").select("row_id", "split", "style", canon.digest_string("example_id").alias("h"))
    return hash_ranks(rows, ["split", "style"], "h", ["row_id"]).select("row_id", "place")


@query("""select event_id from events order by sha256(cast(event_id as varchar)), event_id limit 500""")
def f04_sample_without_replacement(spark, d):
    return table(spark, d, "events").select("event_id").orderBy(F.sha2(F.col("event_id").cast("string"), 256), "event_id").limit(500)


@query("""select row_id from examples where split = 'validation' order by sha256('{"description": ' || coalesce(to_json(description)::varchar, 'null') || ', "style": ' || coalesce(to_json(style)::varchar, 'null') || '}'), row_id limit 64""")
def f05_validation_sample(spark, d):
    rank = canon.digest(canon.json_object({"description": F.col("description"), "style": F.col("style")}))
    return table(spark, d, "examples").filter("split = 'validation'").orderBy(rank, "row_id").limit(64).select("row_id")


@query("""with v as (select arm, list_sort(list(output_tokens)) as v from candidates where output_tokens is not null group by 1) select arm, v[6] as low, v[len(v) - 5] as high from v""")
def f11_sorted_index_limits(spark, d):
    n = table(spark, d, "candidates").filter("output_tokens is not null").groupBy("arm", "output_tokens").agg(F.count(F.lit(1)).alias("n"))
    upto = n.selectExpr("arm", "output_tokens as v", "sum(n) over (partition by arm order by output_tokens) as upto", "sum(n) over (partition by arm) as whole")
    return upto.groupBy("arm").agg(F.min(F.when(F.col("upto") >= 6, F.col("v"))).alias("low"), F.min(F.when(F.col("upto") >= F.col("whole") - 5, F.col("v"))).alias("high"))


@query("""with k as (select 'prompt' as kind, sha256(description) as key, split from examples where description <> '' union all select 'family', family_id, split from examples)
select kind, key from k where key is not null and split is not null group by 1, 2 having count(distinct split) > 1""")
def g03_exclusive_keys(spark, d):
    prompt = F.when(F.col("description") != "", F.sha2("description", 256))
    return contracts.exclusive(table(spark, d, "examples"), {"prompt": prompt, "family": F.col("family_id")}, "split")


@query("""select row_id, case when family_id is null then split = 'validation' and style = 'complete' else split in ('validation', 'test') end as allowed from examples where split is not null and style is not null""")
def h08_evaluation_gate(spark, d):
    rows = table(spark, d, "examples").filter("split is not null and style is not null")
    return rows.select("row_id", contracts.may_evaluate(F.col("split"), F.col("family_id").isNull(), F.col("style") == "complete").alias("allowed"))


@query(f"""with c as (select row_id, ('0x' || substr(sha256('["rarity", ' || to_json(example_id)::varchar || ']'), 1, 8))::bigint % 5 = 0 as explicit, target.rarity as rarity from examples where example_id is not null and target.rarity is not null)
select rarity, count(*) as n, count_if(explicit) as explicit from c group by 1""")
def h13_explicit_subset(spark, d):
    explicit = canon.hash_bucket(canon.digest_list(F.lit("rarity"), F.col("example_id")), 5) == 0
    rows = table(spark, d, "examples").filter("example_id is not null and target.rarity is not null").select("target.rarity", explicit.alias("explicit"))
    return rows.groupBy("rarity").agg(F.count(F.lit(1)).alias("n"), F.count_if("explicit").alias("explicit"))


@query("""select card_no, replace(coalesce(oracle_text, ''), name, 'this card') as shown from cards where name <> ''""")
def i16_display_binding(spark, d):
    return table(spark, d, "cards").filter("name <> ''").select("card_no", F.replace(F.coalesce("oracle_text", F.lit("")), "name", F.lit("this card")).alias("shown"))


@query("""select sha256(case_id) as blind_id, raw from candidates where case_id is not null and raw is not null""")
def j10_blinded_cases(spark, d):
    return table(spark, d, "candidates").filter("case_id is not null and raw is not null").select(F.sha2("case_id", 256).alias("blind_id"), "raw")


@query("""select e.row_id, coalesce(a.type_line, e.target.type_line) as type_line, a.oracle_id is not null as corrected from examples e left join (select oracle_id, min(json_extract_string(record, '$.type_line')) as type_line from printed_wordings where oracle_id is not null group by 1) a on a.oracle_id = e.source.oracle_id""")
def j13_audited_correction(spark, d):
    """Type lines as printed in place of those of the target, where the card was printed at all."""
    audit = table(spark, d, "printed_wordings").filter("oracle_id is not null").groupBy("oracle_id").agg(F.min(F.get_json_object("record", "$.type_line")).alias("fixed"), F.lit(True).alias("has"))
    rows = table(spark, d, "examples").select("row_id", F.col("source.oracle_id").alias("oracle_id"), "target.type_line")
    return rows.join(audit, "oracle_id", "left").select("row_id", F.coalesce("fixed", "type_line").alias("type_line"), F.coalesce("has", F.lit(False)).alias("corrected"))


@query("""select row_id, trim(coalesce(description, '')) <> '' and trim(coalesce(target.oracle_text, '')) <> '' as valid from examples""")
def j15_chat_validate(spark, d):
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    chat = F.array(m("user", F.col("description")), m("assistant", F.col("target.oracle_text")))
    return table(spark, d, "examples").select("row_id", contracts.roles_valid(chat).alias("valid"))


@query("""select w.wording_id as wording_id, substr(sha256('["pair", ' || to_json(w.oracle_id)::varchar || ', ' || to_json(w.oracle_text)::varchar || ']'), 1, 24) as pair_id from printed_wordings w where w.oracle_id is not null and w.oracle_text <> ''""")
def j22_identity_pairs(spark, d):
    rows = table(spark, d, "printed_wordings").filter("oracle_id is not null and oracle_text <> ''")
    return rows.select("wording_id", F.substring(canon.digest_list(F.lit("pair"), F.col("oracle_id"), F.col("oracle_text")), 1, 24).alias("pair_id"))


@query("""select row_id from examples where split in ('train', 'validation') and coalesce(origin, '') <> 'replay'""")
def k21_never_the_test_split(spark, d):
    return table(spark, d, "examples").filter("split in ('train', 'validation') and coalesce(origin, '') <> 'replay'").select("row_id")


@query("""select o_orderkey, least(greatest(ceil(o_totalprice / 10), 1800), 12600) as seconds, o_totalprice + 2 * o_totalprice / 8 >= 200000 as exhausted from orders""")
def m15_clamped_limits(spark, d):
    seconds = F.least(F.greatest(F.ceil(F.col("o_totalprice") / 10).cast("double"), F.lit(1800.0)), F.lit(12600.0))
    return table(spark, d, "orders").select("o_orderkey", seconds.alias("seconds"), (F.col("o_totalprice") + 2 * F.col("o_totalprice") / 8 >= 200000).alias("exhausted"))
