"""The folder in which jobs keep what they read again: all executors must see it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see; a cluster has to name the shared one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", master := spark.conf.get("spark.master", "")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, at: str) -> DataFrame:
    """The rows, written to ``at`` once and read from there."""
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
