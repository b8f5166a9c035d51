"""Stored intermediate results for jobs that read one result several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by the session's ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


def local_folder(spark: SparkSession) -> None:
    """For entry points and tests: name a folder of this machine where none is set and all tasks run here."""
    context = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()) and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trackloom-"))


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table."""
    return f"{shared_folder(spark)}/trackloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    A lost executor then costs one task of this table, not the lineage behind
    it, and every later reader still prunes columns.
    """
    spark = df.sparkSession
    path = stage_folder(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
