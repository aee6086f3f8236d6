"""Paired statistics and vector search (inventory L, C20, C21, F08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.operators import joins, statistics
from sievewright.queries.registry import query
from sievewright.sources.tables import table

_PAIRED = """p as (select case_id, max(case when arm = 'base' then cast(not coalesce(hit_token_limit, false) as integer) end) as before, max(case when arm = 'sft' then cast(not coalesce(hit_token_limit, false) as integer) end) as after from candidates where case_id is not null group by 1),
q as (select substr(sha256(case_id), 1, 2) as family, before, after from p where before is not null and after is not null)"""


def _paired(spark, d):
    rows = table(spark, d, "candidates").filter("case_id is not null").withColumn("family", F.substring(F.sha2("case_id", 256), 1, 2))
    return joins.paired_arms(rows, "case_id", "arm", "base", "sft", ~F.coalesce("hit_token_limit", F.lit(False)), "family")


def _paired_by_group(spark, d):
    """As `_paired`, but the family is the source group of the case's example, else its family, else the case alone."""
    key = lambda c, kind: F.concat(F.lit(kind), F.min(F.lower(F.trim(c))))
    known = table(spark, d, "examples").filter("example_id is not null").groupBy(F.col("example_id").alias("case_id"))
    known = known.agg(F.coalesce(key("source_group_id", "group:"), key("family_id", "family:")).alias("known"))
    pairs = _paired(spark, d).drop("family").join(known, "case_id", "left")
    return pairs.withColumn("family", F.coalesce("known", F.concat(F.lit("case:"), "case_id"))).drop("known")


@query(f"""with {_PAIRED}, kn as (select example_id as case_id, coalesce('group:' || min(lower(trim(source_group_id))), 'family:' || min(lower(trim(family_id)))) as known from examples where example_id is not null group by 1),
fm as (select coalesce(known, 'case:' || p.case_id) as family, after - before as diff from p left join kn on kn.case_id = p.case_id where before is not null and after is not null)
select count(distinct family) as families, count(*) as cases, round(100.0::double * sum(diff) / count(*), 6) as estimate from fm""")
def l01_point_estimate(spark, d):
    """What the intervals of L01 to L04 are about, without the random limits."""
    return l01_group_bootstrap(spark, d).select("families", "cases", "estimate")


@query()
def l01_group_bootstrap(spark, d):
    return statistics.class_bootstrap(_paired_by_group(spark, d), "family", F.col("after") - F.col("before"))


@query(f"""with {_PAIRED}, t as (select count_if(after > before) as g, count_if(before > after) as l from q)
select g as gained, l as lost, round(least(1.0, 2 * (select sum(exp(lgamma(g + l + 1) - lgamma(i + 1) - lgamma(g + l - i + 1) - (g + l) * ln(2))) from range(least(g, l) + 1) r(i))), 6) as p from t""")
def l05_sign_test(spark, d):
    t = _paired(spark, d).agg(F.count_if(F.expr("after > before")).alias("gained"), F.count_if(F.expr("before > after")).alias("lost"))
    return t.select("gained", "lost", F.round(statistics.sign_test(F.col("gained"), F.col("lost")), 6).alias("p"))


@query(f"""with {_PAIRED} select round(100.0 * avg(after - before), 6)::double as points, count_if(after > before) as gained, count_if(before > after) as lost from q""")
def l06_percentage_points(spark, d):
    return _paired(spark, d).agg(F.round(F.lit(100.0) * F.avg(F.col("after") - F.col("before")), 6).alias("points"), F.count_if(F.expr("after > before")).alias("gained"), F.count_if(F.expr("before > after")).alias("lost"))


@query("""with r as (select arm, count_if(not coalesce(hit_token_limit, false)) / count(*) as rate from candidates where arm is not null group by 1)
select x.arm as arm, round(x.rate - y.rate, 6) as change from r x join r y on y.arm = 'base' and x.arm <> 'base'""")
def l07_change_against_base(spark, d):
    rate = table(spark, d, "candidates").filter("arm is not null").groupBy("arm").agg((F.count_if(~F.coalesce("hit_token_limit", F.lit(False))) / F.count(F.lit(1))).alias("rate"))
    base = rate.filter("arm = 'base'").select(F.col("rate").alias("base_rate"))
    return rate.filter("arm <> 'base'").crossJoin(base).select("arm", F.round(F.col("rate") - F.col("base_rate"), 6).alias("change"))


def _neighbours(spark, d, k):
    rows = table(spark, d, "embeddings").withColumnsRenamed({"vec_id": "id", "embedding": "vector"})
    asked = rows.filter("id % 50 = 0").withColumnRenamed("id", "qid")
    return statistics.top_k_similar(asked, rows, k)


_COS = """n as (select vec_id as id, label, list_transform(embedding, lambda v: v::double / sqrt(list_sum(list_transform(embedding, lambda w: w::double * w::double)))) as v from embeddings),
s as (select q.id as query, x.id as item, round(list_dot_product(q.v, x.v), 9) as similarity from n q, n x where q.id % 50 = 0 and x.id <> q.id),
r as (select *, row_number() over (partition by query order by similarity desc, item) as rank from s)"""


@query(f"with {_COS} select query, item, round(similarity, 6) as similarity, rank from r where rank <= 5")
def c20_vector_topk(spark, d):
    return _neighbours(spark, d, 5).withColumn("similarity", F.round("similarity", 6))


def _half(lo: int, hi: int) -> str:
    unit = f"list_transform(embedding[{lo}:{hi}], lambda v: v::double / sqrt(list_sum(list_transform(embedding[{lo}:{hi}], lambda w: w::double * w::double))))"
    return f"(select query, list(item order by rank) as l from (select q.id as query, x.id as item, row_number() over (partition by q.id order by round(list_dot_product(q.v, x.v), 9) desc, x.id) as rank from (select vec_id as id, {unit} as v from embeddings) q, (select vec_id as id, {unit} as v from embeddings) x where q.id % 50 = 0 and x.id <> q.id) where rank <= 5 group by 1)"


@query(f"""with a as {_half(1, 32)}, b as {_half(33, 64)}, m as (select a.query, list_concat(a.l[1:2], b.l[1:1], a.l[3:5], b.l[2:5]) as m from a join b on a.query = b.query), p as (select query, unnest(m) as x, generate_subscripts(m, 1) as i from m), u as (select query, x, min(i) as i from p group by 1, 2), o as (select query, x, row_number() over (partition by query order by i) as n from u)
select query, string_agg(cast(x as varchar), ',' order by n) as items from o where n <= 3 group by 1""")
def f08_interleaved_topk(spark, d):
    """Two rankings of all items, by the first and by the second half of the vectors, merged."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")

    def ranked(first: int, name: str):
        of = rows.select("id", F.slice("embedding", first, 32).alias("vector"))
        top = statistics.top_k_similar(of.filter("id % 50 = 0").withColumnRenamed("id", "qid"), of, 5)
        return top.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"]).alias(name))

    both = ranked(1, "f").join(ranked(33, "s"), "query")
    return both.select("query", F.array_join(statistics.interleave(F.col("f"), F.col("s")), ",").alias("items"))


def _with_references(spark, d):
    """All vectors as questions, and for each the first vector of its label as the reference, except for that one itself."""
    rows = table(spark, d, "embeddings").withColumnsRenamed({"vec_id": "id", "embedding": "vector"})
    asked = rows.withColumnRenamed("id", "qid")
    first = rows.groupBy("label").agg(F.min("id").alias("reference"))
    own = rows.select("id", "label").join(first, "label").filter("id <> reference").select(F.col("id").alias("qid"), "reference")
    return rows, asked, own.join(rows.select(F.col("id").alias("reference"), "vector"), "reference")


_ALL = """u as (select vec_id as id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda w: w::double * w::double))) as size from embeddings),
n as (select id, label, list_transform(embedding, lambda v: v::double / size) as v from u where size > 0),
s as (select q.id as query, x.id as item, round(list_dot_product(q.v, x.v), 9) as similarity from n q, n x where x.id <> q.id),
f as (select label, min(vec_id) as reference from embeddings group by 1),
o as (select s.query, s.item as reference, s.similarity as to_reference from s join n on n.id = s.query join f on f.label = n.label and f.reference = s.item)"""


@query(f"""with {_ALL}, c as (select query, count(*) as items, count_if(similarity > 0.2) as near, min(similarity) as low, max(similarity) as most from s group by 1),
t as (select query, string_agg(cast(item as varchar), ',' order by rank) as nearest from (select query, item, row_number() over (partition by query order by similarity desc, item) as rank from s) where rank <= 3 group by 1)
select c.query as query, items, near, round(low, 6) as low, round(most, 6) as most, nearest, round(to_reference, 6) as to_reference, coalesce(to_reference > 0.9, false) as is_above from c join t on t.query = c.query left join o on o.query = c.query""")
def c21_counts_and_reference(spark, d):
    rows, asked, references = _with_references(spark, d)
    counts = statistics.similarity_counts(asked, rows, 0.2)
    near = statistics.top_k_similar(asked, rows, 3).groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]), ",").alias("nearest"))
    both = counts.join(near, "query").join(statistics.reference_similarity(asked, references), "query", "left")
    six = lambda c: F.round(c, 6).alias(c)
    return both.select("query", "items", "near", six("low"), six("most"), "nearest", six("to_reference"), F.coalesce(F.col("to_reference") > 0.9, F.lit(False)).alias("is_above"))


@query(f"""with {_ALL}, c as (select query, count_if(similarity > 0.9) as near, min(similarity) as low, max(similarity) as most from s group by 1)
select n.label as label, count(*) as queries, round(min(to_reference), 6) as low, round(max(to_reference), 6) as high, count_if(to_reference > 0.9) as above, round(min(c.low), 6) as low_of_all, round(max(c.most), 6) as high_of_all, cast(sum(c.near) as bigint) as above_of_all
from c join n on n.id = c.query left join o on o.query = c.query group by 1""")
def l08_reference_range(spark, d):
    rows, asked, references = _with_references(spark, d)
    counts = statistics.similarity_counts(asked, rows, 0.9).join(rows.select(F.col("id").alias("query"), "label"), "query")
    both = counts.join(statistics.reference_similarity(asked, references), "query", "left")
    six = lambda f, c, name: F.round(f(c), 6).alias(name)
    return both.groupBy("label").agg(
        F.count(F.lit(1)).alias("queries"), six(F.min, "to_reference", "low"), six(F.max, "to_reference", "high"), F.count_if(F.expr("to_reference > 0.9")).alias("above"),
        six(F.min, "low", "low_of_all"), six(F.max, "most", "high_of_all"), F.sum("near").alias("above_of_all"),
    )
