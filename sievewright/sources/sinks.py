"""Outputs that are never overwritten, with receipts (inventory B)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, order: list[str], compression: str = "none", files: int | None = None) -> DataFrame:
    """Rows as JSON lines in the order of `order`, in range-sorted files; the receipt has rows, bytes and a digest.

    The digest is of the sorted rows' digests, so it depends on the content only, not on how files were cut or packed.
    """
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select(line.alias("value")).write.mode("errorifexists").option("compression", compression).text(path)
    return receipt(df)


def receipt(df: DataFrame) -> DataFrame:
    """(`rows`, `bytes`, `digest`): the digest adds 60-bit numbers of the rows' SHA-256 modulo 2^60, any order of rows giving the same."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    number = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    whole = F.pmod(F.coalesce(F.sum(number), F.lit(0).cast("decimal(38,0)")), F.lit(1 << 60).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(line) + 1), F.lit(0)).alias("bytes"), whole.cast("string").alias("digest"))


def replace_json(spark: SparkSession, path: str, value) -> None:
    """A small JSON state file replaced as a whole: written beside it, then renamed over it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(path)
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=1).encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.getFileSystem(conf).getUri(), conf).rename(new, old, overwrite)


def archive(df: DataFrame, path: str) -> dict:
    """A table as Parquet under path/data with manifest.json: its rows, and name, size and hash of each file. Read it by `files.load_archive`."""
    from sievewright.sources.files import file_pins

    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{path}/data")
    pins = file_pins(spark, f"{path}/data").filter("file not like '.%' and file <> '_SUCCESS'").orderBy("file").collect()
    told = {"rows": spark.read.parquet(f"{path}/data").count(), "files": [r.asDict() for r in pins]}
    replace_json(spark, f"{path}/manifest.json", told)
    return told


def vector_index(df: DataFrame, path: str, ident: str, vector: str, dimensions: int, metadata: list[str]) -> dict:
    """Unit vectors with their identifiers and metadata as an archive; null and zero vectors are left out, other dimensions are an error."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    right = F.when(F.size(vector) == dimensions, norm).otherwise(F.raise_error(F.lit(f"a vector has not {dimensions} dimensions")).cast("double"))
    rows = df.filter(F.col(vector).isNotNull()).withColumn("_n", right).filter("_n > 0")
    unit = F.transform(vector, lambda v: (v.cast("double") / F.col("_n")).cast("float"))
    return archive(rows.select(F.col(ident).alias("id"), unit.alias("vector"), *metadata), path)


def write_csv_log(df: DataFrame, path: str, columns: list[str]) -> None:
    """Selected columns as CSV with a header."""
    df.select(*columns).write.mode("errorifexists").option("header", True).csv(path)


def markdown(df: DataFrame, columns: list[str], most: int = 200) -> str:
    """A small results table as Markdown; more than `most` rows are an error."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *map(line, rows)])


def write_formats(df: DataFrame, path: str, formats: dict[str, list[Column]], split: str = "split") -> None:
    """One table in several shapes, each partitioned by split, under path/<shape>."""
    for name, columns in formats.items():
        df.select(split, *columns).write.mode("errorifexists").partitionBy(split).json(f"{path}/{name}")


def write_routed(df: DataFrame, path: str, route: Column) -> None:
    """Every row into the folder of its route, those without one into `unrouted`."""
    df.withColumn("sink", F.coalesce(route, F.lit("unrouted"))).write.mode("errorifexists").partitionBy("sink").parquet(path)


def manifest(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts per group with the content digest of each."""
    number = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(number).cast("string").alias("digest"))


def key_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct (key, value) with a column `conflict` for keys that have several values."""
    per = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_last"))
    return per.select(key, value, (F.col(value) != F.col("_last")).alias("conflict"))
