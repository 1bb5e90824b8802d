"""Reports and set jobs over gate events, reads and similarities.

Nulls: a null read or similarity is left out of counts that compare it. Ties are ordered by event_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .gates import accepted, session_pairing
from .identity import cosine, edit_cer
from .ranges import Ranges


def event_union(events: DataFrame) -> DataFrame:
    """Accepted entries and exits as one tagged table."""
    taken = accepted(events)
    part = lambda kind: taken.where(F.col("kind") == kind).select("event_id", "lot", "plate", "ts", F.lit(kind).alias("type"))
    return part("entry").unionByName(part("exit"))


def active_from_events(events: DataFrame) -> DataFrame:
    """Entries without an exit: who is in now."""
    return session_pairing(events).where("exit_ts IS NULL").select("lot", "plate", "entry_id", "entry_ts")


def dup_semi_join(events: DataFrame) -> DataFrame:
    """Entries refused because the plate is in: those that are not among the accepted."""
    return events.where("kind = 'entry'").join(accepted(events).select("event_id"), "event_id", "left_anti").select("event_id", "lot", "plate", "ts")


def prefix_group(reads: DataFrame) -> DataFrame:
    """prefix, n, low, high of the reads by what stands before the first hyphen."""
    return reads.where("raw <> ''").groupBy(F.split_part("raw", F.lit("-"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))


def min_group_size(events: DataFrame, least: int = 2) -> DataFrame:
    """Events of plates that have ``least`` events or more."""
    often = events.groupBy("plate").count().where(F.col("count") >= least)
    return events.join(often, "plate", "left_semi").select("event_id", "plate")


#: Truth rows of this shape are taken out, and all that depends on them.
EXCLUDED = r"^[0-9]{2}[A-Z][0-9]{6}$"


def pattern_exclude(truth: DataFrame, dependents: dict[str, DataFrame], pattern: str = EXCLUDED) -> dict[str, DataFrame]:
    """The truth rows (id, text) whose text doesn't match, under 'truth', and of each dependent set (id, ...) the rows whose id is not one of a
    truth row that does. A null text matches nothing; rows of a set without an id stay."""
    match = F.coalesce(F.col("text").rlike(pattern), F.lit(False))
    gone = truth.where(match).select("id").distinct()
    return {name: rows.join(gone, "id", "left_anti") for name, rows in {"truth": truth, **dependents}.items()}


def counted_by_id(truth: DataFrame, dependents: dict[str, DataFrame], pattern: str = EXCLUDED) -> DataFrame:
    """id, gone (``pattern_exclude`` takes its rows out), counts (array of part, n for truth and every set). Rows of an id are counted where they are read, in one
    aggregation over all sets: no join, so nothing is sorted, and each id is sent once a task and set, not once a row."""
    hit = F.coalesce(F.col("text").rlike(pattern), F.lit(False))
    parts = [truth.select("id", hit.alias("hit"), F.lit("truth").alias("part")), *[rows.select("id", F.lit(False).alias("hit"), F.lit(name).alias("part")) for name, rows in dependents.items()]]
    count = lambda name: F.struct(F.lit(name).alias("part"), F.count_if(F.col("part") == name).alias("n"))
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg((F.col("id").isNotNull() & F.bool_or("hit")).alias("gone"), F.array(*[count(name) for name in ("truth", *dependents)]).alias("counts"))


def pattern_exclude_counts(truth: DataFrame, dependents: dict[str, DataFrame], pattern: str = EXCLUDED) -> DataFrame:
    """part, removed, kept: rows of each set that ``pattern_exclude`` takes out and leaves."""
    ids = counted_by_id(truth, dependents, pattern)
    n = lambda i, gone: F.coalesce(F.sum(F.when(F.col("gone") == gone, F.col("counts")[i].n)), F.lit(0))
    sums = [F.struct(F.lit(name).alias("part"), n(i, True).alias("removed"), n(i, False).alias("kept")) for i, name in enumerate(("truth", *dependents))]
    return ids.agg(F.array(*sums).alias("sums")).select(F.inline("sums"))


def excluded_sets(reads: DataFrame, chars: DataFrame, boxes: DataFrame, truths: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Truth rows and their four sets: crops, characters of crops, frames, boxes of frames."""
    named = lambda rows, c: rows.select(F.col(c).alias("id"))
    sets = {"crops": named(chars, "crop_id").distinct(), "characters": named(chars, "crop_id"), "frames": named(boxes, "frame_id").distinct(), "boxes": named(truths, "frame_id")}
    return reads.select(F.col("event_id").alias("id"), F.col("pred").alias("text")), sets


def excluded_rows(*tables: DataFrame) -> DataFrame:
    """part, id, n: what is left of every set, by id."""
    ids = counted_by_id(*excluded_sets(*tables)).where("NOT gone")
    return ids.select("id", F.inline("counts")).where("n > 0").select("part", "id", "n")


def excluded_counts(*tables: DataFrame) -> DataFrame:
    return pattern_exclude_counts(*excluded_sets(*tables))


def asof_frames(reads: DataFrame, faces: DataFrame, **cut) -> DataFrame:
    """event_id, image_id: for each read the newest face image with a face of its lane up to then (of equal times the larger id). One sort by lane and
    time over both tables, no range join; a long lane is cut into ranges of time, and the newest image before a range is carried into it."""
    a = reads.select("lane", "ts", "event_id", F.lit(None).cast("long").alias("image_id"))
    b = faces.where("n_faces > 0").select("lane", "ts", F.lit(None).cast("long").alias("event_id"), "image_id")
    ranges = Ranges(a.unionByName(b), "lane", "ts", **cut)
    order = ranges.window("ts", F.col("event_id").isNotNull(), "image_id").rowsBetween(W.unboundedPreceding, 0)
    rows = ranges.rows.withColumn("own", F.last("image_id", ignorenulls=True).over(order))
    newest = F.max_by("image_id", F.when(F.col("image_id").isNotNull(), F.struct("ts", "image_id")))
    rows = ranges.carried(rows, "before", newest, lambda fold: F.last(fold, ignorenulls=True))
    return rows.where("event_id IS NOT NULL").select("event_id", F.coalesce("own", "before").alias("image_id"))


def worst_strings(reads: DataFrame, most: int = 50) -> DataFrame:
    """The predictions farthest from the truth."""
    return edit_cer(reads).where("cer > 0").orderBy(F.desc("cer"), F.desc("dist"), "event_id").limit(most)


def threshold_sweep(exits: DataFrame, active: DataFrame) -> DataFrame:
    """thr (hundredths), right, n: how many pairs of equal plates are judged right at each threshold. Pairs are first
    counted by hundredth, so the sweep is over at most 201 rows whatever the table's size. first_best: the lowest threshold of those with most right."""
    both = exits.select("plate", F.col("identity").alias("i"), F.col("embedding").alias("a")).join(active.select("plate", F.col("identity").alias("j"), F.col("embedding").alias("b")), "plate")
    step = F.floor(F.round(cosine("a", "b"), 6) * 100).cast("int")
    counts = both.select(step.alias("step"), (F.col("i") == F.col("j")).alias("same")).groupBy("step").agg(F.count_if("same").alias("same"), F.count_if(~F.col("same")).alias("other"))
    swept = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("thr"))
    right = F.when(F.col("step") >= F.col("thr"), F.col("same")).otherwise(F.col("other"))
    rows = swept.groupBy("thr").agg(F.sum(right).alias("right"), F.sum(F.col("same") + F.col("other")).alias("n"))
    place = F.row_number().over(W.orderBy(F.desc("right"), "thr"))  # over 100 rows
    return rows.select("thr", "right", "n", F.round(F.col("right") / F.col("n"), 6).alias("acc"), (place == 1).alias("first_best"))
