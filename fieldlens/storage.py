"""Intermediate results in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: With it, Spark drops an execution's shuffle files when the execution ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Without one, a session on a single machine takes its temporary folder
    and any other is an error: executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no lineage.

    Its shuffle files go at once: the steps of an operator don't add up on disk.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", 16 << 20).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stored_with(df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, dict]:
    """As stored, and the aggregates over all rows, taken as they are written."""
    seen = Observation()
    kept = stored(df.observe(seen, *[c.alias(k) for k, c in aggregates.items()]), name)
    return kept, seen.get
