"""Windows, sorts, top-k and sampling (inventory E and F)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.functions import canon, text
from sievewright.operators import windows
from sievewright.queries.registry import query
from sievewright.queries.text import KEY_SQL
from sievewright.sources.tables import table

SHA = "sha256(to_json({0})::varchar)"
GROUP = "lower(trim(source_group_id))"


@query(f"""select g as source_group_id, row_id from (select {GROUP} as g, row_id, row_number() over (partition by {GROUP} order by {SHA.format('example_id')}, row_id) as r from examples where example_id is not null and source_group_id is not null) where r = 1""")
def e01_family_representative(spark, d):
    rows = table(spark, d, "examples").filter("example_id is not null and source_group_id is not null").withColumn("source_group_id", F.lower(F.trim("source_group_id")))
    return windows.first_per_group(rows, ["source_group_id"], [canon.digest_string("example_id"), F.col("row_id")], ["row_id"])


_PRIORITY = "case split when 'test' then 0 when 'validation' then 1 else 2 end"


def _deduplicated(spark, d):
    priority = F.when(F.col("split") == "test", 0).when(F.col("split") == "validation", 1).otherwise(2)
    rows = table(spark, d, "examples").filter("description is not null").withColumn("key", text.description_key(F.col("description")))
    return windows.priority_dedup(rows.select("row_id", "split", "example_id", "key"), "key", [priority, F.col("example_id"), F.col("row_id")], "row_id")


_DEDUP = f"with k as (select row_id, split, {KEY_SQL.format('description')} as key, example_id from examples where description is not null), r as (select *, row_number() over (partition by key order by {_PRIORITY}, example_id nulls first, row_id) as place from k)"


@query(f"{_DEDUP} select row_id, split from r where place = 1")
def e02_priority_dedup(spark, d):
    return _deduplicated(spark, d)[0].select("row_id", "split")


@query(f"{_DEDUP} select row_id, split, 'duplicate_normalized_description' as reason from r where place > 1")
def e02_duplicates_report(spark, d):
    return _deduplicated(spark, d)[1].select("row_id", "split", F.lit("duplicate_normalized_description").alias("reason"))


@query("""with r as (select card_id, family_id, row_number() over (partition by family_id order by submitted_at nulls first, card_id) as n from custom_cards where family_id is not null) select family_id, card_id, max(n) over (partition by family_id) - 1 as near_duplicates from r qualify n = 1""".replace("select family_id, card_id, max(n) over (partition by family_id) - 1 as near_duplicates from r qualify n = 1", "select family_id, min(case when n = 1 then card_id end) as card_id, count(*) - 1 as near_duplicates from r group by 1"))
def e03_first_seen_families(spark, d):
    rows = table(spark, d, "custom_cards").filter("family_id is not null")
    return rows.groupBy("family_id").agg(F.min_by("card_id", F.struct("submitted_at", "card_id")).alias("card_id"), (F.count(F.lit(1)) - 1).alias("near_duplicates"))


@query("""select lower(draft.name) as key, min(card_id) as card_id, array_to_string(list_sort(list(distinct author)), ',') as authors from custom_cards where draft.name is not null and author is not null group by 1""")
def e04_collapse_provenance(spark, d):
    rows = table(spark, d, "custom_cards").filter("draft.name is not null and author is not null")
    return rows.groupBy(F.lower("draft.name").alias("key")).agg(F.min("card_id").alias("card_id"), F.array_join(F.array_sort(F.collect_set("author")), ",").alias("authors"))


@query(f"""with k as (select card_no, {KEY_SQL.format('oracle_text')} as key from cards where oracle_text <> '') select card_no, min(card_no) over (partition by key) as representative, case when card_no = min(card_no) over (partition by key) then count(*) over (partition by key) - 1 else 0 end as equivalents from k""")
def e05_point_to_representative(spark, d):
    rows = table(spark, d, "cards").filter("oracle_text <> ''").select("card_no", text.description_key(F.col("oracle_text")).alias("key"))
    first = rows.groupBy("key").agg(F.min("card_no").alias("representative"), F.count(F.lit(1)).alias("n"))
    here = F.when(F.col("card_no") == F.col("representative"), F.col("n") - 1).otherwise(F.lit(0))
    return rows.join(first, "key").select("card_no", "representative", here.alias("equivalents"))


@query(f"""with f as (select {GROUP} as g, style, row_id, {SHA.format('example_id')} as h from examples where example_id is not null and style is not null and source_group_id is not null),
one as (select *, row_number() over (partition by g, style order by h, row_id) as a from f), cap as (select *, row_number() over (partition by style order by h, row_id) as b from one where a = 1)
select row_id, style from cap where b <= 48""")
def e06_capped_panels(spark, d):
    rows = table(spark, d, "examples").filter("example_id is not null and style is not null and source_group_id is not null").select(F.lower(F.trim("source_group_id")).alias("g"), "style", "row_id", canon.digest_string("example_id").alias("h"))
    one = windows.first_per_group(rows, ["g", "style"], [F.col("h"), F.col("row_id")], ["row_id", "h"])
    return windows.at_most(one, ["style"], [F.col("h"), F.col("row_id")], 48).select("row_id", "style")


@query("""select family_id, card_id from (select family_id, card_id, row_number() over (partition by family_id order by case when coalesce(draft.oracle_text, '') <> '' then 0 else 1 end, card_id) as r from custom_cards where family_id is not null) where r <= 2""")
def e07_two_per_group(spark, d):
    rows = table(spark, d, "custom_cards").filter("family_id is not null")
    preferred = F.when(F.coalesce("draft.oracle_text", F.lit("")) != "", 0).otherwise(1)
    return windows.at_most(rows, ["family_id"], [preferred, F.col("card_id")], 2).select("family_id", "card_id")


@query("""select event_id, cast(sum(cast(value as decimal(18, 2))) over w as double) / count(value) over w as mean from events window w as (partition by user_id order by ts, event_id rows between 49 preceding and current row)""")
def e08_moving_mean(spark, d):
    w = windows.trailing(["user_id"], [F.col("ts"), F.col("event_id")], 50)
    exact = F.sum(F.col("value").cast("decimal(18,2)")).over(w).cast("double")
    return table(spark, d, "events").select("event_id", (exact / F.count("value").over(w)).alias("mean"))


@query(f"""select row_id, case when (row_number() over (partition by style order by {SHA.format('example_id')}, row_id) - 1) % 2 = 0 then 'development' else 'release' end as half from examples where example_id is not null""")
def e09_alternating_halves(spark, d):
    rows = table(spark, d, "examples").filter("example_id is not null").select("row_id", "style", canon.digest_string("example_id").alias("h"))
    ranked = windows.hash_ranks(rows, ["style"], "h", ["row_id"])
    return ranked.select("row_id", F.when(F.col("place") % 2 == 1, "development").otherwise("release").alias("half"))


@query("""select row_id, split, cast(floor((row_number() over (partition by split, style order by row_id) - 1) / 12) as bigint) as batch from examples""")
def e10_batching(spark, d):
    return windows.batches(table(spark, d, "examples"), ["split", "style"], "row_id", 12).select("row_id", "split", "batch")


@query(f"""select candidate_id, arm, cast(floor((row_number() over (partition by arm order by sha256('["judge", ' || to_json(case_id)::varchar || ']'), candidate_id) - 1) / 9) as bigint) as batch from candidates where case_id is not null""")
def e11_shuffled_batches(spark, d):
    rows = table(spark, d, "candidates").filter("case_id is not null").select("candidate_id", "arm", canon.digest_list(F.lit("judge"), F.col("case_id")).alias("h"))
    ranked = windows.hash_ranks(rows, ["arm"], "h", ["candidate_id"])
    return ranked.select("candidate_id", "arm", F.floor((F.col("place") - 1) / 9).alias("batch"))


@query(r"""with l as (select card_no, unnest(string_split(oracle_text, chr(10))) as line, generate_subscripts(string_split(oracle_text, chr(10)), 1) as pos from cards where oracle_text is not null)
select card_no, pos, coalesce(sum(length(line) - length(translate(line, '"“”', ''))) over (partition by card_no order by pos rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as inside from l""")
def e12_quote_depth(spark, d):
    lines = table(spark, d, "cards").filter("oracle_text is not null").select("card_no", F.posexplode(F.split("oracle_text", "\n", -1)).alias("p", "line"))
    marks = F.length("line") - F.length(F.translate("line", '"“”', ""))
    before = F.sum(marks).over(Window.partitionBy("card_no").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    return lines.select("card_no", (F.col("p") + 1).cast("long").alias("pos"), (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))


@query("""with r as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as a, row_number() over (partition by user_id order by ts desc, event_id desc) as z from events)
select user_id, round(avg(case when a <= 25 then value end), 6) as first_mean, round(avg(case when z <= 25 then value end), 6) as last_mean from r group by 1""")
def e13_first_and_last_means(spark, d):
    w = Window.partitionBy("user_id")
    rows = table(spark, d, "events").select("user_id", "value", F.row_number().over(w.orderBy("ts", "event_id")).alias("a"), F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))).alias("z"))
    mean = lambda c: F.round(F.avg(F.when(F.col(c) <= 25, F.col("value"))), 6)
    return rows.groupBy("user_id").agg(mean("a").alias("first_mean"), mean("z").alias("last_mean"))


@query("""with r as (select event_id, user_id, ts, value, lag(value) over (partition by user_id order by ts, event_id) as before from events)
select user_id, max_by(event_id, (ts, event_id)) as latest, count_if(value < before) as regressions from r group by 1""".replace("max_by(event_id, (ts, event_id))", "arg_max(event_id, row(ts, event_id))"))
def e14_latest_and_regressions(spark, d):
    rows = table(spark, d, "events").withColumn("before", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"), F.count_if(F.expr("value < before")).alias("regressions"))


@query(f"""with s as (select row_id, {SHA.format('example_id')} as h, origin from examples where example_id is not null), a as (select row_id from s order by h, row_id limit 200), b as (select row_id from s where origin = 'custom' order by h, row_id limit 50) select row_id from a union select row_id from b""")
def f03_bottom_k_union(spark, d):
    rows = table(spark, d, "examples").filter("example_id is not null").select("row_id", "origin", canon.digest_string("example_id").alias("h"))
    k = lambda x, n: x.orderBy("h", "row_id").limit(n).select("row_id")
    return k(rows, 200).union(k(rows.filter("origin = 'custom'"), 50)).distinct()


@query("""select candidate_id from (select candidate_id, row_number() over (partition by arm order by sha256(coalesce(raw, '')), candidate_id) as r from candidates) where r <= 16""")
def f06_first_by_content(spark, d):
    rows = table(spark, d, "candidates").select("candidate_id", "arm", F.sha2(F.coalesce("raw", F.lit("")), 256).alias("h"))
    return windows.at_most(rows, ["arm"], [F.col("h"), F.col("candidate_id")], 16).select("candidate_id")


@query(f"""with e as (select case_id, count_if(hit_token_limit or raw is null or raw = '') as errors, {SHA.format('case_id')} as h from candidates where case_id is not null group by case_id),
hard as (select case_id from e where errors > 0 order by errors desc, h limit 100), ctl as (select case_id from e where case_id not in (select case_id from hard) order by h limit 28)
select case_id, 'hard' as kind from hard union all select case_id, 'control' from ctl""")
def f07_hard_cases(spark, d):
    rows = table(spark, d, "candidates").filter("case_id is not null")
    per = rows.groupBy("case_id").agg(F.count_if(F.expr("hit_token_limit or raw is null or raw = ''")).alias("errors")).withColumn("h", canon.digest_string("case_id"))
    hard = per.filter("errors > 0").orderBy(F.desc("errors"), "h").limit(100).select("case_id")
    control = per.join(hard, "case_id", "left_anti").orderBy("h").limit(28).select("case_id")
    return hard.withColumn("kind", F.lit("hard")).unionByName(control.withColumn("kind", F.lit("control")))


@query("""with r as (select row_id, style, row_number() over (partition by style order by row_id) as n, count(*) over (partition by style) as c from examples) select row_id, style from r where n <= c - c % 8""")
def f09_multiple_of_8(spark, d):
    rows = table(spark, d, "examples").select("row_id", "style")
    counts = rows.groupBy("style").agg(F.count(F.lit(1)).alias("c")).withColumnRenamed("style", "s")
    placed = windows.range_ranks(rows, ["style"], "row_id", []).join(F.broadcast(counts), F.col("style").eqNullSafe(F.col("s")))  # a row a style
    return placed.filter("place <= c - c % 8").select("row_id", "style")


@query("""select doc_id, length(text) as n from documents where text is not null order by length(text), doc_id limit 64""")
def f10_shortest_first(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.length("text").cast("long").alias("n"))
    return docs.orderBy("n", "doc_id").limit(64)
