"""Queries that write through the sinks, archives, caches and streams and give back what is then read (inventory A, B and M)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievewright.functions import canon
from sievewright.operators import boundary
from sievewright.queries.registry import query
from sievewright.queries.windows import SHA
from sievewright.sources import files, sinks
from sievewright.sources.shared import materialize, shared_folder
from sievewright.sources.tables import table
from sievewright.streaming import incremental


def _place(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query("select set_code, set_name, cast(released_on as varchar) as released_on from card_sets")
def a01_json_lines(spark, d):
    """A table written as JSON lines and scanned with its schema."""
    path = _place(spark, "lines")
    sinks.write_lines(table(spark, d, "card_sets").withColumn("released_on", F.col("released_on").cast("string")), path, ["set_code"])
    return files.json_lines(spark, path, "set_code string, set_name string, released_on string")


@query("select set_code, set_name from card_sets")
def a08_work_folder(spark, d):
    """A folder of JSON documents, one record each, read in the order of their names."""
    path = _place(spark, "work")
    rows = table(spark, d, "card_sets").select("set_code", "set_name")
    rows.repartition(rows.count(), "set_code").write.option("maxRecordsPerFile", 1).json(path)  # a document a set
    return files.work_folder(spark, path, "set_code string, set_name string").select("set_code", "set_name")


@query("select event_type, count(*) as n, round(sum(value), 6) as total from events group by 1")
def b12_csv_log(spark, d):
    """Selected columns of a log as CSV, read back with their types."""
    path = _place(spark, "log")
    per = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("ts").alias("last"))
    sinks.write_csv_log(per, path, ["event_type", "n", "total"])
    return files.csv_log(spark, path, "event_type string, n long, total double")


@query("select 'data' as part, count(*) as rows, true as checked from embeddings where embedding is not null")
def b11_vector_index(spark, d):
    """A vector index written as an archive and loaded after its files, hashes and rows are checked."""
    path = _place(spark, "index")
    told = sinks.vector_index(table(spark, d, "embeddings"), path, "vec_id", "embedding", 64, ["label"])
    return files.load_archive(spark, path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("data").alias("part"), "rows", (F.col("rows") == told["rows"]).alias("checked"))


@query("""select split, shape, count(*) as rows from examples, (select unnest(['records', 'messages', 'sft']) as shape) where split is not null and description <> '' group by 1, 2""")
def b04_three_formats(spark, d):
    """One table written in three shapes, partitioned by split, and counted from what was written."""
    path = _place(spark, "formats")
    rows = table(spark, d, "examples").filter("split is not null and description <> ''")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = F.array(message("user", F.col("description")), message("assistant", F.to_json("target")))
    shapes = {"records": [F.col("row_id"), F.col("description"), F.col("target")], "messages": [F.col("row_id"), messages.alias("messages")], "sft": [F.col("description").alias("prompt"), F.to_json("target").alias("completion")]}
    sinks.write_formats(rows, path, shapes)
    out = None
    for name in shapes:
        part = spark.read.schema("split string").json(f"{path}/{name}").groupBy("split").agg(F.count(F.lit(1)).alias("rows")).select("split", F.lit(name).alias("shape"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""select row_id, case when split = 'test' and ('0x' || substr({SHA.format('example_id')}, 1, 8))::bigint % 2 = 0 then 'reserve' when split is null then 'unrouted' else split end as sink from examples where example_id is not null""")
def b05_reserve_route(spark, d):
    """Rows written to the folder of their route, half of the test rows in reserve, and read back with it."""
    path = _place(spark, "routes")
    held = (F.col("split") == "test") & (canon.hash_bucket(canon.digest_string("example_id"), 2) == 0)
    rows = table(spark, d, "examples").filter("example_id is not null").select("row_id", "split", "example_id")
    sinks.write_routed(rows, path, F.when(held, "reserve").otherwise(F.col("split")))
    return spark.read.schema("row_id long, sink string").parquet(path).select("row_id", "sink")


@query("""select split, style, count(*) as rows, count(distinct example_id) as ids, count_if(description is null or trim(description) = '') as blank, true as pinned from examples group by 1, 2""")
def b07_manifest_counts(spark, d):
    """Counts and checks per split and style, of an archive whose files match their pins."""
    path = _place(spark, "manifest")
    sinks.archive(table(spark, d, "examples").select("row_id", "example_id", "split", "style", "description"), path)
    rows = files.load_archive(spark, path)
    return rows.groupBy("split", "style").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("example_id").alias("ids"), F.count_if(F.expr("description is null or trim(description) = ''")).alias("blank"), F.lit(True).alias("pinned"))


@query("""select distinct user_id || '/' || event_type || '/' || strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as key from events where user_id is not null and event_type is not null""")
def m05_append_once(spark, d):
    """Keys of the events appended by a stream that is run twice: each is there once."""
    path, checkpoint = _place(spark, "appended"), _place(spark, "offsets")
    source = f"{d}/events.parque[t]"  # a pattern, since the table may be one file
    key = F.concat_ws("/", F.col("user_id").cast("string"), "event_type", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH"))
    for _ in range(2):
        stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(source).filter("user_id is not null and event_type is not null").select(key.alias("key"))
        incremental.append_once(stream, "key", path, checkpoint).awaitTermination()
    return spark.read.schema("key string").parquet(path)


@query("""select o_orderkey, case when o_totalprice > 400000 then 'needs_review' else 'completed' end as state from orders""")
def m01_durable_queue(spark, d):
    """Orders as jobs of a queue that is run twice: each is worked on once, the largest need review."""
    folder, path, checkpoint = _place(spark, "jobs"), _place(spark, "done"), _place(spark, "offsets")
    jobs = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    jobs.write.json(folder)
    state = F.when(F.col("o_totalprice") > 400000, "needs_review").otherwise("completed")
    for _ in range(2):
        incremental.run_queue(spark, folder, jobs.schema, "o_orderkey", lambda b: b.select("o_orderkey", state.alias("state")), path, checkpoint).awaitTermination()
    return incremental.queue_states(jobs, spark.read.schema("o_orderkey long, state string").parquet(path), "o_orderkey")


def _lengths():
    return lambda items: [str(len(x)) for x in items]


@query("""with d as (select candidate_id, raw, row_number() over (partition by sha256(raw) order by candidate_id) = 1 as fresh from candidates where raw <> '')
select candidate_id, length(raw)::varchar as result, 'done' as status from d""")
def m09_content_cache(spark, d):
    """Results for every output, each content being evaluated once: the second half of the arms meets the cache of the first."""
    rows = table(spark, d, "candidates").filter("raw <> ''").select("candidate_id", "raw", "arm")
    empty = spark.createDataFrame([], "content_hash string, status string, result string")
    early = F.coalesce(F.col("arm").isin("base", "sft"), F.lit(False))
    first, new = boundary.cached(rows.filter(early), "candidate_id", "raw", empty, _lengths, "pin-1")
    cache = materialize(new, "cache")
    second, _ = boundary.cached(rows.filter(~early), "candidate_id", "raw", cache, _lengths, "pin-1")
    return first.unionByName(second).select("candidate_id", "result", "status")


@query("""select o_orderkey, least(12600, greatest(1800, cast(ceil(o_totalprice / 100 * 1.5) as bigint))) as seconds from orders where o_totalprice >= 100""")
def m13_segment_limits(spark, d):
    """Seconds of a segment from the steps that remain, here a hundredth of an order's price at one second each, between the bounds."""
    seconds = incremental.segment_seconds(F.col("o_totalprice") / 100, F.lit(1.0))
    return table(spark, d, "orders").filter("o_totalprice >= 100").select("o_orderkey", seconds.cast("long").alias("seconds"))


@query("""with r as (select set_code, count(*) as n, row_number() over (order by set_code) - 1 as i from printed_wordings where set_code is not null group by 1), g as (select *, sum(n) over (order by set_code) as approved, n as gained from r)
select set_code, coalesce(i < 40 and approved + gained * 1.5 < 1000, false) as ahead from g""")
def m11_look_ahead(spark, d):
    """Whether to begin the next set early while the wordings so far, and half as much again as the last set gave, stay below the target."""
    from pyspark.sql.window import Window

    per = table(spark, d, "printed_wordings").filter("set_code is not null").groupBy("set_code").agg(F.count(F.lit(1)).alias("n"))  # a row a set
    w = Window.orderBy("set_code")
    g = per.select("set_code", "n", (F.row_number().over(w) - 1).alias("i"), F.sum("n").over(w).alias("approved"))
    return g.select("set_code", incremental.look_ahead(F.col("i"), 40, F.col("approved"), F.col("n"), F.lit(1000)).alias("ahead"))


@query("""select arm, max(max_tokens) as minutes, round(max(max_tokens) * 0.02::double, 6) as cap, max(max_tokens) * 0.02::double <= 10 as allowed from candidates where arm is not null group by 1""")
def m17_cost_cap(spark, d):
    """The longest limit of an arm as minutes at a price, and whether that is within the budget."""
    per = table(spark, d, "candidates").filter("arm is not null").groupBy("arm").agg(F.max("max_tokens").alias("minutes"))
    cap, allowed = incremental.cost_cap(F.col("minutes"), F.lit(0.02), F.lit(10.0))
    return per.select("arm", "minutes", F.round(cap, 6).alias("cap"), allowed.alias("allowed"))
