"""Resumable steps as Structured Streaming: append once, refresh what is new, follow a folder (inventory M).

State is what the sink already holds plus the query's own checkpoint; running a step again adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sievewright.sources.files import read_bytes
from sievewright.sources.sinks import replace_json


def append_once(stream: DataFrame, key: str, path: str, checkpoint: str, watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """Rows of a stream appended to a parquet table, each key once over all runs.

    Without a watermark the keys seen are kept for good, so give one where time bounds repeats.
    """
    rows = stream if watermark is None else stream.withWatermark(*watermark)
    once = rows.dropDuplicates([key]) if watermark is None else rows.dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_queue(spark: SparkSession, folder: str, schema: T.StructType | str, key: str, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, files_per_batch: int = 100, drain: str | None = None, late: tuple[str, str] | None = None) -> StreamingQuery:
    """A folder of JSON files as a durable queue: each batch of new files is worked on and written, known keys left out.

    Keys seen are state of the query, spread over its partitions; with `late` (time column, delay) they are kept for that long
    only. A batch is one folder `run=R/batch=N` that is written as a whole, so one tried again after a failure replaces what it
    left, and the sink is not read; only after a lost checkpoint, which begins another run, are its keys. A batch whose `work` fails ends the query; what was finished before stays, and the next
    run goes on there. While a file named `drain` exists no new batch is begun.
    """

    def exists(name: str) -> bool:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    before = None
    if exists(f"{checkpoint}/run.json"):
        run = json.loads(read_bytes(spark, f"{checkpoint}/run.json"))
    else:
        run = {"run": uuid.uuid4().hex, "after_others": exists(path)}
        replace_json(spark, f"{checkpoint}/run.json", run)
    if run["after_others"]:
        before = spark.read.parquet(path).filter(F.col("run") != run["run"]).select(key)

    def each(batch: DataFrame, number: int) -> None:
        if drain is not None and exists(drain):
            raise InterruptedError(f"{drain} asks to stop before batch {number}")
        todo = batch if before is None else batch.join(before, key, "left_anti")
        work(todo).write.mode("overwrite").parquet(f"{path}/run={run['run']}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    once = stream.dropDuplicates([key]) if late is None else stream.withWatermark(*late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def queue_states(jobs: DataFrame, done: DataFrame, key: str, state: str = "state") -> DataFrame:
    """(`key`, `state`) of every job: what the results say (such as completed or needs_review), else pending."""
    return jobs.select(key).distinct().join(done.select(key, state).distinct(), key, "left").select(key, F.coalesce(state, F.lit("pending")).alias(state))


def whole_lines(spark: SparkSession, path: str, schema: T.StructType | str, key: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, refused lines) of an append log of JSON lines: a torn line, an unknown key and a repeated key are refused, with the reason.

    The first line of a key counts, in the order of the bytes of its line. Refused lines are kept for audit.
    """
    lines = spark.read.text(path).filter("trim(value) <> ''")
    read = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("torn", ~F.trim("value").rlike(r"^\{[\s\S]*\}$") | F.col(f"r.{key}").isNull())
    ids = known.select(F.col(key).alias("_known")).distinct()
    held = read.join(ids, F.col(f"r.{key}") == F.col("_known"), "left")
    first = held.filter("not torn and _known is not null").groupBy("_known").agg(F.min("value").alias("_first"), F.count(F.lit(1)).alias("_n"))
    rows = first.select(F.from_json("_first", schema).alias("r")).select("r.*")
    more = first.filter("_n > 1").select(F.lit("repeated").alias("reason"), F.col("_first").alias("line"))
    wrong = held.filter("torn or _known is null").select(F.when(F.col("torn"), "torn").otherwise("unknown").alias("reason"), F.col("value").alias("line"))
    return rows, wrong.unionByName(more)


def cost_cap(minutes: Column, price: Column, budget: Column | None = None) -> tuple[Column, Column]:
    """(cap, allowed): the timeout at the unit price, and whether it is within the budget; without a positive price nothing is allowed."""
    cap = minutes * price
    within = F.lit(True) if budget is None else (budget > 0) & (cap <= budget)
    return cap, F.coalesce((price > 0) & within, F.lit(False))


def look_ahead(index: Column, most: int, approved: Column, gained: Column, target: Column) -> Column:
    """Whether to begin the next batch early: one was completed, more are allowed, and half as much again as its yield does not reach the target."""
    return F.coalesce((index < most) & gained.isNotNull() & (approved + gained * F.lit(1.5) < target), F.lit(False))


def segment_seconds(remaining: Column, speed: Column, least: int = 1800, most: int = 12600) -> Column:
    """Half as much again as the remaining steps take at the measured speed (4 seconds each if none), between bounds; null without steps."""
    measured = F.coalesce(speed, F.lit(4.0))
    return F.when((remaining >= 1) & (measured > 0), F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(remaining * measured * F.lit(1.5)))))


def missing_slots(cases: DataFrame, done: DataFrame, key: str, copies: int) -> DataFrame:
    """(`key`, `slot`) of the grid cases x copies that are not done yet."""
    grid = cases.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("slot"))
    return grid.join(done.select(key, "slot").distinct(), [key, "slot"], "left_anti")


def running_budget(df: DataFrame, by: list[str], order: list[str], amount: str, limit: float) -> DataFrame:
    """Running sum of an append log per group, and whether a row would go beyond the limit."""
    part = f"partition by {', '.join(by)} " if by else ""
    total = F.expr(f"sum({amount}) over ({part}order by {', '.join(order)} rows between unbounded preceding and current row)")
    return df.withColumn("reserved", F.round(total, 6)).withColumn("over_limit", F.col("reserved") > limit)


def settled(minutes: Column, price: Column, original: Column) -> Column:
    """What a finished reservation may cost: whole minutes and two more at the price, never above the original."""
    return F.least(original, (F.ceil(minutes) + 2) * price)


def tumbling(stream: DataFrame, time: str, width: str, late: str, by: list[str], value: str) -> DataFrame:
    """Counts and sums per window of event time; rows later than `late` are dropped by the watermark. An extension."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
