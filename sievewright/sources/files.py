"""Files as tables: JSON lines, compressed snapshots, nested documents, work folders, pinned files and CSV logs (inventory A)."""

from __future__ import annotations

import hashlib
import json
import lzma
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLITS = ("train", "validation", "test")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, partitions: int | None = None) -> DataFrame:
    """Line-delimited JSON, plain or gzip, with an explicit schema; a line that is no JSON fails the read.

    A gzip file is one task, so give `partitions` to spread what follows.
    """
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.repartition(partitions) if partitions else df


def split_files(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """`train.jsonl`, `validation.jsonl` and `test.jsonl` of a folder with their `split`; a missing file is no rows."""
    jvm = spark.sparkContext._jvm
    parts = []
    for split in SPLITS:
        path = f"{folder}/{split}.jsonl"
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            parts.append(json_lines(spark, path, schema).withColumn("split", F.lit(split)))
    if not parts:
        return spark.createDataFrame([], schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).withColumn("split", F.lit(None).cast("string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nested_document(spark: SparkSession, path: str, schema: T.StructType | str, sets: str, items: str) -> DataFrame:
    """One JSON document holding a map of sets, each with an array of items: one row per item with its set's key."""
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    per = doc.select(F.explode(sets).alias("set_key", "set_value"))
    return per.select("set_key", F.explode(f"set_value.{items}").alias("item")).select("set_key", "item.*")


def xz_to_lines(source: str, target: str, block: int = 1 << 20) -> None:
    """Landing step: an xz file, which Spark would read as garbage rows, is unpacked in blocks."""
    with lzma.open(source, "rb") as packed, open(target, "wb") as out:
        while data := packed.read(block):
            out.write(data)


def work_folder(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """A folder of JSON files, one record each, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*.json").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def csv_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def _file_system(spark: SparkSession, path: str):
    """(Hadoop file system, qualified path) of a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(target)


def is_link(spark: SparkSession, path: str) -> bool:
    """Whether a path is a symbolic link."""
    fs, target = _file_system(spark, path)
    if fs.getUri().getScheme() == "file":
        return os.path.islink(target.toUri().getPath())
    return fs.getFileLinkStatus(target).isSymlink()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """The content of one small file, such as a manifest."""
    fs, target = _file_system(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def file_pins(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """(`file`, `bytes`, `sha256`) of each file below a folder, or of those named; `file` is the path below the folder.

    A file is held by one task while it is hashed, so it may be of 2 GB at most: data belong in files smaller than that.
    """
    root = str(_file_system(spark, folder)[1])
    paths = [folder] if names is None else [f"{folder}/{n}" for n in names]
    if not paths:
        return spark.createDataFrame([], "file string, bytes long, sha256 string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", names is None).load(paths)
    below = F.substring(F.regexp_replace("path", "^file:/+", "file:/"), len(root) + 2, 1 << 30)
    return files.select(below.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def check_pins(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """What differs from a manifest (`file`, `sha256`): missing, changed or unlisted files, links, and names with a path in them.

    Names are compared as paths below the folder, so `sub/c` never stands for `c`. A link is refused whatever it points to.
    """
    found = file_pins(spark, folder).select("file", F.col("sha256").alias("found"))
    fs, root = _file_system(spark, folder)
    listed = [(name,) for name in (s.getPath().getName() for s in fs.listStatus(root)) if is_link(spark, f"{folder}/{name}")]
    links = spark.createDataFrame(listed, "file string").withColumn("link", F.lit(True))
    state = F.when(F.col("link"), "link").when(F.contains("file", F.lit("/")) & F.col("sha256").isNotNull(), "nested")
    state = state.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("found") != F.col("sha256"), "changed")
    every = manifest.select("file", "sha256").join(found, "file", "full").join(links, "file", "full")
    return every.withColumn("state", state).filter("state is not null").select("file", "state")


def checked(spark: SparkSession, folder: str, manifest: DataFrame, leaks: dict[str, bool] | None = None) -> str:
    """The folder if it matches its manifest and no leak flag is set, else an error that names what is wrong."""
    if told := sorted(k for k, v in (leaks or {}).items() if v is not False):
        raise ValueError("leaks: " + ", ".join(told))
    wrong = check_pins(spark, folder, manifest).limit(20).collect()
    if wrong:
        raise ValueError("files differ from the manifest: " + ", ".join(f"{r['file']} {r['state']}" for r in wrong))
    return folder


def checked_file(spark: SparkSession, folder: str, name: str, manifest: DataFrame) -> str:
    """The path of one pinned file, only it being read; nested names, links, unlisted and changed files are errors."""
    fs, target = _file_system(spark, f"{folder}/{name}")
    if "/" in name or name in ("", ".", ".."):
        raise ValueError(f"{name}: not a plain name")
    if not fs.exists(target):
        raise ValueError(f"{name}: missing")
    if is_link(spark, f"{folder}/{name}"):
        raise ValueError(f"{name}: a link")
    pins = {r["sha256"] for r in manifest.filter(F.col("file") == name).select("sha256").collect()}
    if {r["sha256"] for r in file_pins(spark, folder, [name]).collect()} != pins:
        raise ValueError(f"{name}: not as pinned")
    return f"{folder}/{name}"


def load_sources(spark: SparkSession, folder: str, name: str, manifest: DataFrame, schema: T.StructType | str, key: str) -> DataFrame:
    """A pinned file of JSON lines as rows with a unique key that is not null; else an error."""
    rows = json_lines(spark, checked_file(spark, folder, name, manifest), schema)
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col(key).isNull() | (F.col("n") > 1)).limit(5).collect()
    if repeated:
        raise ValueError("keys are null or repeated: " + ", ".join(str(r[key]) for r in repeated))
    return rows


def source_manifest(spark: SparkSession, folder: str) -> dict:
    """The `source` part of a folder's manifest.json; a child that only names its parent's must also pin its bytes.

    `source_root` is absolute, or relative to the folder.
    """
    data = json.loads(read_bytes(spark, f"{folder}/manifest.json"))
    if "source" not in data:
        parent = data["source_root"]
        parent = parent if parent.startswith("/") or "://" in parent else f"{folder}/{parent}"
        blob = read_bytes(spark, f"{parent}/manifest.json")
        if hashlib.sha256(blob).hexdigest() != data["source_manifest_sha256"]:
            raise ValueError("the parent's manifest changed")
        data = json.loads(blob)
    return data["source"]


def load_archive(spark: SparkSession, path: str) -> DataFrame:
    """A table written by `sinks.archive`, after its files, their hashes and its rows are checked against its manifest."""
    told = json.loads(read_bytes(spark, f"{path}/manifest.json"))
    manifest = spark.createDataFrame([(f["file"], f["sha256"]) for f in told["files"]], "file string, sha256 string")
    rows = spark.read.parquet(checked(spark, f"{path}/data", manifest.filter("file not like '.%' and file <> '_SUCCESS'")))
    if (n := rows.count()) != told["rows"]:
        raise ValueError(f"{n} rows, {told['rows']} in the manifest")
    return rows


def vectors(spark: SparkSession, path: str, dimensions: int, vector: str = "embedding") -> DataFrame:
    """A vector table whose rows all have the stated dimensions; a wrong one fails when read."""
    df = spark.read.parquet(path)
    right = F.when(F.size(vector) == dimensions, F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector has not {dimensions} dimensions")))
    return df.withColumn(vector, right)
