"""Cutting lineage through written tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# While a table is written.  The JVM never compiles a method above 8000 bytes, and the generated one of
# a scored pair has about 50 000; above this limit Spark evaluates the projection in small functions.
# A megabyte of raster or pairs is much work, so small shuffles keep more tasks than one.
WRITING = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir.

    Where none is set, a local master gets a temporary one; on a cluster that
    would be another folder on every machine, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder as a table and read on from there.

    A lost executor then reads the files again instead of repeating the history.
    A written table also has a known size, so the planner broadcasts it only
    when it is small; a checkpointed RDD keeps multiplied size estimates instead.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fieldlink-{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        df.write.mode("error").option("compression", "zstd").parquet(path)
    system, target = location(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


@contextmanager
def measured_joins(spark: SparkSession):
    """Sides of joins are broadcast only where adaptive execution has measured them.

    The planner takes a written table to be as large as its files.  A row of ids has two
    to five bytes there and forty in memory, and copies made by ``explode`` do not count,
    so a side of ten megabytes by that estimate can need gigabytes of the driver.  In this block all
    joins are planned with a shuffle, whose true size decides then, by the session's limit.
    """
    adaptive, planned = "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.autoBroadcastJoinThreshold"
    limit = spark.conf.get(adaptive, None) or spark.conf.get(planned)
    with settings(spark, {planned: "-1", adaptive: limit}):
        yield


def in_parts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys over as many tasks as a shuffle has, however few bytes they are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for a block; the ones before it come back."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote, once nothing reads it any more."""
    system, target = location(df.sparkSession, df._written_at)
    system.delete(target, True)


def location(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target
