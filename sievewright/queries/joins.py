"""Joins and set predicates (inventory C and G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import canon
from sievewright.operators import joins
from sievewright.operators.windows import hash_ranks
from sievewright.queries.registry import query
from sievewright.sources.tables import table

GROUP = "lower(trim(source_group_id))"


@query("""with j as (select e.row_id, c.rarity, ('0x' || substr(sha256('["names", ' || to_json(e.example_id)::varchar || ']'), 1, 8))::bigint % 5 = 0 as twice from examples e join (select oracle_id, min(rarity) as rarity from cards group by 1) c on e.source.oracle_id = c.oracle_id where e.example_id is not null)
select row_id, rarity, false as variant from j union all select row_id, rarity, true from j where twice""")
def c01_dimension_join_with_variants(spark, d):
    dim = table(spark, d, "cards").groupBy("oracle_id").agg(F.min("rarity").alias("rarity"))
    rows = table(spark, d, "examples").filter("example_id is not null").select("row_id", "example_id", F.col("source.oracle_id").alias("oracle_id"))
    twice = canon.hash_bucket(canon.digest_list(F.lit("names"), F.col("example_id")), 5) == 0
    return rows.join(dim, "oracle_id").select("row_id", "rarity", F.explode(F.when(twice, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("variant"))


@query("""select wording_id, w.oracle_id as oracle_id from printed_wordings w where w.oracle_id in (select source.oracle_id from examples where split = 'train')""")
def c02_semi_join_before_parse(spark, d):
    wanted = table(spark, d, "examples").filter("split = 'train'").select(F.col("source.oracle_id").alias("oracle_id")).distinct()
    return table(spark, d, "printed_wordings").select("wording_id", "oracle_id").join(wanted, "oracle_id", "left_semi").select("wording_id", "oracle_id")


@query("""select e.row_id, c.card_no, sha256(coalesce(e.target.name, '')) = sha256(coalesce(c.name, '')) as agrees from examples e join cards c on e.source.oracle_id = c.oracle_id""")
def c03_hash_guarded_join(spark, d):
    rows = table(spark, d, "examples").select("row_id", F.col("source.oracle_id").alias("oracle_id"), F.col("target.name").alias("target_name"))
    cards = table(spark, d, "cards").select("card_no", "oracle_id", "name")
    h = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")), 256)
    return joins.guarded_join(rows, cards, "oracle_id", h("target_name"), h("name")).select("row_id", "card_no", "agrees")


@query("""with p as (select case_id, case when max(length(raw)) > 0 then 'generated' else 'generation_error' end as status from candidates group by 1),
x as (select row_id, example_id from examples where split in ('validation', 'test'))
select row_id, coalesce(p.status, 'missing') as status from x left join p on x.example_id = p.case_id""")
def c04_left_join_denominator(spark, d):
    cases = table(spark, d, "examples").filter("split in ('validation', 'test')").select("row_id", F.col("example_id").alias("case_id"))
    outcome = F.when(F.max(F.length("raw")) > 0, "generated").otherwise("generation_error")
    predictions = table(spark, d, "candidates").groupBy("case_id").agg(outcome.alias("status"))
    return joins.keep_cases(cases, predictions, "case_id").select("row_id", "status")


@query(f"select row_id from examples where split = 'train' and {GROUP} not in (select {GROUP} from examples where split in ('validation', 'test') and source_group_id is not null)")
def c05_heldout_antijoin(spark, d):
    rows = table(spark, d, "examples").select("row_id", "split", F.lower(F.trim("source_group_id")).alias("g"))
    return joins.exclude(rows.filter("split = 'train'"), [rows.filter("split in ('validation', 'test') and g is not null")], "g").select("row_id")


@query("""with k as (select family_id from examples where split = 'test' and family_id is not null union select family_id from examples where origin = 'repair' and family_id is not null)
select card_id from custom_cards c where not exists (select 1 from k where k.family_id = c.family_id)""")
def c06_exclusion_from_many(spark, d):
    rows = table(spark, d, "examples").filter("family_id is not null")
    return joins.exclude(table(spark, d, "custom_cards"), [rows.filter("split = 'test'"), rows.filter("origin = 'repair'")], "family_id").select("card_id")


@query("""with b as (select family_id, min(('0x' || substr(sha256(to_json(family_id)::varchar), 1, 8))::bigint % 4) as batch from custom_cards where family_id is not null group by 1),
r as (select e.row_id, ('0x' || substr(sha256(to_json(e.example_id)::varchar), 1, 8))::bigint % 4 as batch, family_id from examples e where family_id is not null)
select row_id from r where not exists (select 1 from b where b.family_id = r.family_id and b.batch < r.batch)""")
def c07_accumulating_exclusion(spark, d):
    earlier = table(spark, d, "custom_cards").filter("family_id is not null").groupBy("family_id").agg(F.min(canon.hash_bucket(canon.digest_string("family_id"), 4)).alias("first_batch"))
    rows = table(spark, d, "examples").filter("family_id is not null").select("row_id", "family_id", canon.hash_bucket(canon.digest_string("example_id"), 4).alias("batch"))
    return rows.join(earlier, "family_id", "left").filter("first_batch is null or first_batch >= batch").select("row_id")


@query("""with a as (select case_id, max(case when arm = 'sft' then cast(not coalesce(hit_token_limit, false) as integer) end) as before, max(case when arm = 'dpo' then cast(not coalesce(hit_token_limit, false) as integer) end) as after from candidates where arm in ('sft', 'dpo') group by 1)
select case_id, before, after from a where before is not null and after is not null""")
def c08_paired_arms(spark, d):
    ok = ~F.coalesce("hit_token_limit", F.lit(False))
    rows = table(spark, d, "candidates").withColumn("family", F.lit(0))
    return joins.paired_arms(rows, "case_id", "arm", "sft", "dpo", ok, "family").select("case_id", "before", "after")


@query("""with a as (select case_id, arm, max(output_tokens) as t from candidates group by 1, 2)
select x.arm as candidate, y.arm as baseline, count(*) as cases, count_if(x.t > y.t) as longer from a x join a y on x.case_id = y.case_id and x.arm = 'teacher' and y.arm <> 'teacher' group by 1, 2""")
def c09_every_baseline(spark, d):
    per = table(spark, d, "candidates").groupBy("case_id", "arm").agg(F.max("output_tokens").alias("t"))
    ours = per.filter("arm = 'teacher'").select("case_id", F.col("arm").alias("candidate"), F.col("t").alias("ours"))
    theirs = per.filter("arm <> 'teacher'").withColumnRenamed("arm", "baseline")
    return ours.join(theirs, "case_id").groupBy("candidate", "baseline").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.expr("ours > t")).alias("longer"))


@query("""select c.card_no, count(*) as printings, count(distinct w.set_code) as sets from printed_wordings w join cards c on w.oracle_id = c.oracle_id where lower(trim(w.lang)) in ('en', 'english') group by 1""")
def c11_printings_by_source(spark, d):
    printed = table(spark, d, "printed_wordings").filter("lower(trim(lang)) in ('en', 'english')").select("oracle_id", "set_code")
    cards = table(spark, d, "cards").select("card_no", "oracle_id")
    return printed.join(cards, "oracle_id").groupBy("card_no").agg(F.count(F.lit(1)).alias("printings"), F.countDistinct("set_code").alias("sets"))


@query("""select card_no, len(list_filter(card_faces, lambda f: list_contains(list_transform(string_split(name, ' // '), lambda n: n), f.name))) = len(card_faces) and len(string_split(name, ' // ')) = len(card_faces) as complete from cards where len(card_faces) > 0 and name is not null""")
def c12_face_assembly(spark, d):
    parts = F.split("name", " // ")
    named = F.filter("card_faces", lambda f: F.array_contains(parts, f["name"]))
    complete = (F.size(named) == F.size("card_faces")) & (F.size(parts) == F.size("card_faces"))
    return table(spark, d, "cards").filter("size(card_faces) > 0 and name is not null").select("card_no", complete.alias("complete"))


@query("""with p as (select card_id, upper(draft.rarity) as rarity from custom_cards where draft.rarity is not null and card_id % 3 = 0)
select c.card_id, coalesce(p.rarity, c.draft.rarity) as rarity, p.card_id is not null as patched from custom_cards c left join p on p.card_id = c.card_id""")
def c13_overlay_merge(spark, d):
    rows = table(spark, d, "custom_cards").select("card_id", "draft.rarity")
    patches = rows.filter("rarity is not null and card_id % 3 = 0").withColumn("rarity", F.upper("rarity"))
    return joins.overlay(rows, patches, "card_id", ["rarity"])


@query(f"""with g as (select {GROUP} as g, min(case split when 'test' then 0 when 'validation' then 1 when 'train' then 2 end) as p from examples where source_group_id is not null group by 1)
select g as group_id, case p when 0 then 'test' when 1 then 'validation' when 2 then 'train' else case ('0x' || substr(sha256(to_json(g)::varchar), 1, 8))::bigint % 10 when 0 then 'test' when 1 then 'validation' else 'train' end end as split from g""")
def c14_split_map_default(spark, d):
    priority = F.when(F.col("split") == "test", 0).when(F.col("split") == "validation", 1).when(F.col("split") == "train", 2)
    groups = table(spark, d, "examples").select(F.lower(F.trim("source_group_id")).alias("group_id"), priority.alias("p")).filter("group_id is not null").groupBy("group_id").agg(F.min("p").alias("p"))
    h = canon.hash_bucket(canon.digest_string("group_id"), 10)
    by_hash = F.when(h == 0, "test").when(h == 1, "validation").otherwise("train")
    return groups.select("group_id", F.when(F.col("p") == 0, "test").when(F.col("p") == 1, "validation").when(F.col("p") == 2, "train").otherwise(by_hash).alias("split"))


@query("""select case when e.example_id is null then 'unknown' else 'bound' end as state, count(*) as n from candidates c left join (select distinct example_id from examples where split in ('validation', 'test')) e on c.case_id = e.example_id group by 1""")
def c15_checked_bind(spark, d):
    cases = table(spark, d, "examples").filter("split in ('validation', 'test')").select(F.col("example_id").alias("case_id"), F.lit(True).alias("known")).distinct()
    rows = table(spark, d, "candidates").join(cases, "case_id", "left")
    return rows.groupBy(F.when(F.col("known"), "bound").otherwise("unknown").alias("state")).agg(F.count(F.lit(1)).alias("n"))


_RULES = [("moves", r"\b(shuffle|unearth|banish)\b", None), ("counts", r"[0-9]+ or (more|fewer)", r"counter"), ("modal", "Choose a", "named"), ("quoted", "“", None)]


@query(" union all ".join(f"select card_no, '{i}' as rule from cards where regexp_matches(oracle_text, '{p}')" + (f" and not coalesce(regexp_matches(oracle_text, '{a}'), false)" if a else "") for i, p, a in _RULES))
def c16_regex_theta_join(spark, d):
    return joins.theta_rules(table(spark, d, "cards"), _RULES, F.col("oracle_text"), F.col("oracle_text")).select("card_no", "rule")


@query(r"""select doc_id, len(regexp_extract_all(text, '[^\s]+', 0)) as words from documents where text is not null""")
def c18_distinct_eval_fanout(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    count = lambda x: x.select("content_hash", F.size(F.regexp_extract_all("content", F.lit(r"[^\s]+"), F.lit(0))).cast("long").alias("words"))
    return joins.once_per_content(docs.filter("text is not null"), F.col("text"), count).select("doc_id", "words")


@query("""with c as (select distinct source.oracle_id as oracle_id from examples where split = 'train')
select case when c.oracle_id is null then 'pending' else 'reused' end as state, count(*) as n from (select distinct oracle_id from printed_wordings where oracle_id is not null) w left join c on c.oracle_id = w.oracle_id group by 1""")
def c19_reused_and_pending(spark, d):
    keys = table(spark, d, "printed_wordings").select("oracle_id").filter("oracle_id is not null").distinct()
    cache = table(spark, d, "examples").filter("split = 'train'").select(F.col("source.oracle_id").alias("oracle_id"))
    reused, pending = joins.split_by_cache(keys, cache, "oracle_id")
    both = reused.select(F.lit("reused").alias("state")).unionByName(pending.select(F.lit("pending").alias("state")))
    return both.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""with l as (select row_id, 'case-' || cast(row_number() over (partition by style order by sha256(to_json(example_id)::varchar), row_id) as varchar) as label, style from examples where example_id is not null)
select row_id, style, label from l""")
def c28_opaque_labels(spark, d):
    rows = table(spark, d, "examples").filter("example_id is not null").select("row_id", "style", canon.digest_string("example_id").alias("h"))
    ranked = hash_ranks(rows, ["style"], "h", ["row_id"])
    return ranked.select("row_id", "style", F.concat(F.lit("case-"), F.col("place").cast("string")).alias("label"))


@query("""select example_id, count(*) as n, count(distinct sha256(coalesce(description, ''))) as contents from examples where example_id is not null group by 1 having count(*) > 1""")
def g01_merge_conflicts(spark, d):
    rows = table(spark, d, "examples").filter("example_id is not null")
    per = rows.groupBy("example_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.sha2(F.coalesce("description", F.lit("")), 256)).alias("contents"))
    return per.filter("n > 1")


@query("""select family_id from examples where split = 'train' and family_id is not null intersect select family_id from examples where split = 'test' and family_id is not null""")
def g02_intersection(spark, d):
    rows = table(spark, d, "examples").filter("family_id is not null")
    return rows.filter("split = 'train'").select("family_id").intersect(rows.filter("split = 'test'").select("family_id"))


@query(f"""select {GROUP} as key, count(distinct split) as splits, count(*) as rows from examples where split is not null and source_group_id is not null group by 1 having count(distinct split) > 1""")
def g04_cross_split_leak(spark, d):
    rows = table(spark, d, "examples").filter("split is not null and source_group_id is not null")
    per = rows.groupBy(F.lower(F.trim("source_group_id")).alias("key")).agg(F.countDistinct("split").alias("splits"), F.count(F.lit(1)).alias("rows"))
    return per.filter("splits > 1")


@query("""select r.split as split, r.style as style from (select s.split, t.style from (select distinct split from examples where split is not null) s, (select distinct style from examples where style is not null) t) r
left join (select distinct split, style from examples where description <> '' and target.loyalty is null) x on x.split = r.split and x.style = r.style where x.split is null""".replace(" and target.loyalty is null", " and origin = 'replay'"))
def g06_required_coverage(spark, d):
    rows = table(spark, d, "examples")
    splits, styles = rows.select("split").filter("split is not null").distinct(), rows.select("style").filter("style is not null").distinct()
    required = splits.crossJoin(styles)  # both are enumerations
    return required.join(rows.filter("description <> '' and origin = 'replay'").select("split", "style").distinct(), ["split", "style"], "left_anti")


@query("""with p as (select row_id, example_id, 'a' as pool, 1 as rank from examples where split = 'train' and style = 'minimal' union all select row_id, example_id, 'b', 2 from examples where split = 'train' and origin = 'custom')
select row_id, max_by(pool, rank) as pool from p group by 1""")
def g07_union_last_wins(spark, d):
    rows = table(spark, d, "examples").filter("split = 'train'")
    pools = rows.filter("style = 'minimal'").select("row_id", F.lit("a").alias("pool"), F.lit(1).alias("rank")).unionByName(rows.filter("origin = 'custom'").select("row_id", F.lit("b").alias("pool"), F.lit(2).alias("rank")))
    return pools.groupBy("row_id").agg(F.max_by("pool", "rank").alias("pool"))


@query("""with t as (select count(distinct case_id) as all_cases from candidates) select arm, count(distinct case_id) as cases, count(distinct case_id) = max(all_cases) as complete, count(distinct max_tokens) = 1 as one_setting from candidates, t where arm is not null group by 1""")
def g11_arms_cover_cases(spark, d):
    rows = table(spark, d, "candidates")
    total = rows.agg(F.countDistinct("case_id").alias("all_cases"))
    per = rows.filter("arm is not null").groupBy("arm").agg(F.countDistinct("case_id").alias("cases"), F.countDistinct("max_tokens").alias("settings"))
    return per.crossJoin(total).select("arm", "cases", (F.col("cases") == F.col("all_cases")).alias("complete"), (F.col("settings") == 1).alias("one_setting"))

