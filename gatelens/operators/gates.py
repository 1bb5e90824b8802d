"""Jobs over gate events (event_id, lot, plate, ts, kind): sessions, occupancy, newest entries; keyed by lot and plate.

An entry while the plate is in is a duplicate, an exit while it is out has no session; both follow from the event before,
so no state is carried. Events with equal times are ordered by event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import Ranges


def accepted(events: DataFrame) -> DataFrame:
    """The events that change who is in."""
    order = W.partitionBy("lot", "plate").orderBy("ts", "event_id")
    before = F.lag("kind").over(order)
    return events.withColumn("before", F.coalesce(before, F.lit("exit"))).where("kind <> before").drop("before")


def session_pairing(events: DataFrame) -> DataFrame:
    """lot, plate, entry_id, entry_ts, exit_ts, duration_min (whole minutes, truncated; null while in)."""
    order = W.partitionBy("lot", "plate").orderBy("ts", "event_id")
    paired = accepted(events).withColumn("exit_ts", F.lead("ts").over(order)).where("kind = 'entry'")
    minutes = F.expr("CAST(timestampdiff(MICROSECOND, ts, exit_ts) DIV 60000000 AS BIGINT)")
    return paired.select("lot", "plate", F.col("event_id").alias("entry_id"), F.col("ts").alias("entry_ts"), "exit_ts", minutes.alias("duration_min"))


def occupancy_timeline(events: DataFrame, **cut) -> DataFrame:
    """lot, event_id, ts, occupancy after each accepted event. The history of a lot with many events is cut into ranges of time: each is summed by
    itself, and the sums of the ranges before are carried into it."""
    step = F.when(F.col("kind") == "entry", 1).otherwise(-1)
    ranges = Ranges(accepted(events), "lot", "ts", **cut)
    rows = ranges.rows.withColumn("own", F.sum(step).over(ranges.window("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)))
    rows = ranges.carried(rows, "before", F.sum(step), F.sum)
    return rows.select("lot", "event_id", "ts", (F.col("own") + F.coalesce("before", F.lit(0))).cast("long").alias("occupancy"))


def occupancy_stats(events: DataFrame, capacity: int = 500) -> DataFrame:
    """lot, current, capacity, pct (one decimal)."""
    now = accepted(events).groupBy("lot").agg(F.greatest(F.sum(F.when(F.col("kind") == "entry", 1).otherwise(-1)), F.lit(0)).cast("long").alias("current"))
    return now.select("lot", "current", F.lit(capacity).cast("long").alias("capacity"), F.round(100.0 * F.col("current") / max(capacity, 1), 1).alias("pct"))


def active_recent(events: DataFrame, most: int = 50) -> DataFrame:
    """The newest sessions that are still open."""
    return session_pairing(events).where("exit_ts IS NULL").orderBy(F.desc("entry_ts"), F.desc("entry_id")).limit(most).select("lot", "plate", "entry_id", "entry_ts")


def history_recent(events: DataFrame, most: int = 20) -> DataFrame:
    """The newest finished sessions."""
    return session_pairing(events).where("exit_ts IS NOT NULL").orderBy(F.desc("exit_ts"), F.desc("entry_id")).limit(most)


def plate_vote(reads: DataFrame, width: int = 5, least: int = 3, **cut) -> DataFrame:
    """event_id, lane, stable: the value that holds half or more of the last reads that are not empty, the oldest first on
    ties; null below ``least`` reads. A lane with many reads is cut into ranges of time, each with the last reads before it."""
    ranges = Ranges(reads.where("raw <> ''").select("event_id", "lane", "ts", "raw"), "lane", "ts", **cut)
    order = ranges.window("ts", "event_id").rowsBetween(1 - width, 0)
    held = ranges.with_halo(width - 1, "ts", "event_id").withColumn("held", F.collect_list("raw").over(order)).where("NOT halo")
    votes = F.transform(F.array_distinct("held"), lambda v: F.struct(F.size(F.filter("held", lambda x: x == v)).alias("n"), (-F.array_position("held", v)).alias("age"), v.alias("value")))
    held = held.withColumn("top", F.array_max(votes))
    return held.select("event_id", "lane", F.when((F.size("held") >= least) & (F.col("top.n") * 2 >= F.size("held")), F.col("top.value")).alias("stable"))


def frame_sample(frames: DataFrame, every: int = 3, **cut) -> DataFrame:
    """Every n-th frame of each lane, counted from 1; the count of the ranges before is carried into each range of a long lane."""
    ranges = Ranges(frames.select("event_id", "lane", "ts"), "lane", "ts", **cut)
    rows = ranges.rows.withColumn("own", F.row_number().over(ranges.window("ts", "event_id")))
    rows = ranges.carried(rows, "before", F.count("*"), F.sum)
    return rows.where((F.col("own") + F.coalesce("before", F.lit(0))) % every == 0).select("event_id", "lane")


def fps_per_second(frames: DataFrame) -> DataFrame:
    """Frames of each lane in each second that has any."""
    return frames.groupBy("lane", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("second")).agg(F.count("*").alias("frames"))


def event_feed(events: DataFrame, most: int = 50) -> DataFrame:
    """The newest accepted events."""
    newest = accepted(events).orderBy(F.desc("ts"), F.desc("event_id")).limit(most)
    return newest.select("event_id", "lot", "plate", "ts", F.col("kind").alias("type"))


def session_display(events: DataFrame) -> DataFrame:
    """entry_id, plate, entered, left ('' while in), stay: texts for a listing."""
    iso = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    stay = F.coalesce(F.concat(F.col("duration_min").cast("string"), F.lit(" min")), F.lit(""))
    return session_pairing(events).select("entry_id", "plate", iso("entry_ts").alias("entered"), iso("exit_ts").alias("left"), stay.alias("stay"))


def source_route(frames: DataFrame) -> DataFrame:
    """event_id, source: frames of source 0 are plates, of source 1 faces; others are dropped."""
    return frames.where("source_id IN (0, 1)").select("event_id", F.when(F.col("source_id") == 0, "plate").otherwise("face").alias("source"))


def like_scope(events: DataFrame, pattern: str = "P1_%") -> DataFrame:
    """Events whose plate is LIKE the pattern; an underscore stands for any one character."""
    return events.where(F.col("plate").like(pattern)).select("event_id", "plate")


def scan_active(active: DataFrame, plate: str | None = None) -> DataFrame:
    """id, plate, identity of the gallery, all of it or one plate; the vectors are not read."""
    return (active if plate is None else active.where(F.col("plate") == plate)).select("id", "plate", "identity")


def plate_suffix_join(exits: DataFrame, keyed: DataFrame) -> DataFrame:
    """event_id, key for keys 'PREFIX|plate' whose last part is the plate: the key is split once, so it is an equi join."""
    return exits.select("event_id", "plate").join(keyed.select("key", F.substring_index("key", "|", -1).alias("plate")), "plate").select("event_id", "key")


def camera_health(frames: DataFrame, gap: str = "6 hours") -> DataFrame:
    """lane, up_from, up_to, frames for each period in which the frames of a lane follow each other within the gap."""
    order = W.partitionBy("lane").orderBy("ts", "event_id")
    late = F.coalesce(F.col("ts") > F.lag("ts").over(order) + F.expr(f"INTERVAL {gap}"), F.lit(True))
    periods = frames.withColumn("late", late).withColumn("period", F.sum(F.col("late").cast("int")).over(order))
    return periods.groupBy("lane", "period").agg(F.min("ts").alias("up_from"), F.max("ts").alias("up_to"), F.count("*").alias("frames")).drop("period")
