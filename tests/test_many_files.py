from pyspark.sql import functions as F

from gatelens.streaming import jobs


def test_more_than_a_thousand_files_are_one_stream_in_time(spark):
    # days apart and out of order over 1,040 files, so that a second batch would be behind the first one's watermark
    frames = spark.range(1040).select((F.col("id") % 2).alias("lane"), F.timestamp_seconds(F.col("id") * 86400 * 2).alias("ts")).repartitionByRange(1040, F.desc("ts"))
    batches = jobs.gathered(spark, frames, lambda s: s, "append", "many")
    assert batches.select("batch").distinct().count() == 1 and batches.count() == 1040
    assert jobs.stream_fps(frames).count() == 1040
