"""Intermediate tables in the folder that all executors share.

A table written here cuts the lineage as `checkpoint()` does, but keeps columns apart, is compressed, and
may be read several times with different filters. It outlives lost executors.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`; a temporary one is set only where none is (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sievewright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` once into the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    made = spark.read.schema(df.schema).parquet(path)
    made._written_at = path
    return made


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(df: DataFrame) -> None:
    """Delete the written table that `materialize` returned as `df`, which nothing reads any more; other tables stay."""
    path = getattr(df, "_written_at", None)
    if path:
        _delete(df.sparkSession, path)
        _written.remove((df.sparkSession, path))


def drop_materialized() -> None:
    """Delete the tables written by this process; results that still read them are lost."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone
            pass


atexit.register(drop_materialized)
