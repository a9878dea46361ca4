"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset and all runs in this process (as in tests), a temporary folder."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not shared and (context.master == "local" or context.master.startswith("local[")):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        shared = context.getCheckpointDir()
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return shared.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: its lineage ends there, and each row is worked out once."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
