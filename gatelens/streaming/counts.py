"""Structured Streaming over gate events: counts of each lane and hour, kept as events come.

State is one count for each lane and hour within the watermark. Every batch appends the counts that it changed with its
number; the newest of each is the result. Events later than the watermark allows are left out; null times are never counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import folder


def stream_hourly_counts(spark: SparkSession, sf_dir: str, late: str = "1 day") -> DataFrame:
    """lane, hour, n after all events that the folder holds now; a later run with the same checkpoint would go on from there."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out = folder(spark, "hourly")
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq*")
    # event time must be an instant; the session's zone leads there and back
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = events.withWatermark("ts", late).groupBy(F.col("user_id").alias("lane"), F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    rows = counts.select("lane", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    rows.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{out}/rows")
    return found.groupBy("lane", "hour").agg(F.max_by("n", "batch").alias("n"))
