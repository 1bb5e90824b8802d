"""Streams with keyed state: batches out of time order give what the batch forms give; timers close what nobody sends to any more."""

import random

from pyspark.sql import functions as F

from gatelens.operators import gates, identity
from gatelens.sources.views import view
from gatelens.streaming import jobs

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def jumbled(spark, df, path, hours=20, files=4):
    """The rows as a stream of several files, each row up to ``hours`` later than its time says."""
    spread = random.Random(3)
    held = sorted((r.ts.timestamp() + spread.random() * hours * 3600, tuple(r)) for r in df.collect())
    size = -(-len(held) // files)
    for i in range(files):
        spark.createDataFrame([r for _, r in held[i * size : (i + 1) * size]], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_votes_of_jumbled_batches_equal_the_batch_form(spark, tmp_path):
    reads = view(spark, SF, "v_reads").select("event_id", "lane", "ts", "raw")
    want = rows(gates.plate_vote(reads).select("event_id", "lane", "stable"))
    assert want and rows(jobs.stream_vote(jumbled(spark, reads, f"{tmp_path}/in"))) == want


def test_averages_of_jumbled_batches_equal_the_batch_form(spark, tmp_path):
    faces = view(spark, SF, "v_face_vectors")
    near = lambda df: [(i, lane, [round(x, 9) for x in avg]) for i, lane, avg in rows(df.select("image_id", "lane", "avg"))]
    want = near(jobs.stream_embedding_avg(faces))
    assert {r[0] for r in want} == {r.image_id for r in identity.embedding_avg(faces).collect()}
    assert near(jobs.stream_embedding_avg(jumbled(spark, faces, f"{tmp_path}/in"))) == want


def test_periods_and_outages_of_jumbled_batches_equal_the_batch_form(spark, tmp_path):
    seen = view(spark, SF, "v_seen")
    feed = jumbled(spark, seen, f"{tmp_path}/in")
    want = rows(gates.camera_health(seen).select("lane", "up_from", "up_to", "frames"))
    assert rows(jobs.stream_camera_health(feed, delay="1 day")) == want
    gaps = [(a[0], a[2], b[1]) for a, b in zip(sorted(want), sorted(want)[1:]) if a[0] == b[0]]
    assert gaps and rows(jobs.stream_camera_outages(feed, delay="1 day")) == sorted(gaps, key=repr)


def test_a_timer_closes_a_silent_lane(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "folder", lambda session, name: f"file://{tmp_path}/out")
    frames = spark.createDataFrame([(1, 0), (1, 2), (2, 1), (2, 500), (2, 501), (None, 7), (1, None)], "lane long, s long").selectExpr("lane", "timestamp_seconds(s + 1000) AS ts")
    got = jobs.stream_camera_health(frames, gap=3, delay="1 second", files=2).selectExpr("lane", "unix_seconds(timestamp(up_from)) - 1000 AS a", "unix_seconds(timestamp(up_to)) - 1000 AS b", "frames")
    assert rows(got) == [(1, 0, 2, 2), (2, 1, 1, 1), (2, 500, 501, 2)]
    closed = spark.read.parquet(f"file://{tmp_path}/out/rows").select("lane", (F.col("up_to") / 1_000_000 - 1000).cast("long"))
    assert rows(closed) == [(1, 2), (2, 1)]  # the last period is still open


def test_settled_reads_leave_the_buffer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "folder", lambda session, name: f"file://{tmp_path}/out")
    reads = spark.createDataFrame([(i, i % 3, 3600 + i * 3600, "A") for i in range(60)], "event_id long, lane long, ts long, raw string")
    assert jobs.stream_vote(reads, files=3, delay="2 hours").count() == 60
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"file://{tmp_path}/out/state")
    kept = spark.read.format("statestore").option("stateVarName", "kept").load(f"file://{tmp_path}/out/state")
    assert waiting.count() < 10 and kept.count() == 15  # five votes a lane, whatever its history


def test_state_of_empty_feeds(spark):
    empty = spark.createDataFrame([], "event_id long, lane long, ts timestamp, raw string")
    assert jobs.stream_vote(empty).count() == 0 and jobs.stream_camera_health(empty).count() == 0


def test_lanes_share_the_keys_of_the_state(spark, tmp_path, monkeypatch):
    """A key of state costs the same whatever it holds, so their number must not grow with the lanes."""
    monkeypatch.setattr(jobs, "folder", lambda session, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(jobs, "BUCKETS", 2)
    reads = spark.createDataFrame([(i, i % 20, 3600 + i * 60, "AB"[i % 3 == 0]) for i in range(120)], "event_id long, lane long, ts long, raw string")
    want = rows(gates.plate_vote(reads.withColumn("ts", F.timestamp_seconds("ts"))).select("event_id", "lane", "stable"))
    assert rows(jobs.stream_vote(reads, files=2)) == want
    assert rows(jobs.stream_camera_health(reads, gap=2000).select("lane", "frames")) == sorted([(lane, 6) for lane in range(20)], key=repr)
    for name, kept in (("vote", "waiting"), ("health", "open")):
        state = spark.read.format("statestore").option("stateVarName", kept).load(f"file://{tmp_path}/{name}/state")
        assert state.select("list_element.lane").distinct().count() == 20 and state.select("key").distinct().count() == 2
