"""Logs and tables kept for a while in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where they go if the session names no folder and runs on one machine.
LOCAL = "file:///tmp/checkpoints"


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``, deleted when the driver's JVM ends."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = LOCAL
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written_lines(df: DataFrame, tag: str) -> str:
    """The folder to which the one string column of ``df`` was written, a line for each row."""
    path = scratch_folder(df.sparkSession, tag)
    df.write.text(path)
    return path


def written_table(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read again, so that a lost executor costs a reread."""
    path = scratch_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
