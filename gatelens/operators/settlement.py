"""Exits settled against active records, each record once.

An exit asks for the first record of its lot and plate that is still there, by (entry_ts, id), and takes it if the faces agree; a
record is there from its entry on. So the records of a plate are taken in their order, and each by the first exit, by (ts, id), that comes after the one that took
the record before and passes. This is done in rounds over all plates at once: the n-th record of every plate is proposed to its open exits,
the first that passes accepts, those up to it are settled, the later ones go on to the next record. A round is two joins and an
aggregate, written to the shared folder; there are as many rounds as records that one plate has lost, and one more. As a plate that is in is refused
at the entry, that is seldom more than two; a plate with very many records takes as many rounds.

Null lots or plates find nothing. A null vector never passes. Of repeated rows each counts; equal times go by id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import folder, written
from .identity import cosine

KEY = ["lot", "plate"]


def in_turn(active: DataFrame) -> DataFrame:
    """The records with their number within lot and plate."""
    order = W.partitionBy(*KEY).orderBy("entry_ts", "id", F.xxhash64("embedding"))
    return active.select("id", *KEY, "entry_ts", "embedding").withColumn("turn", F.row_number().over(order))


def settled(exits: DataFrame, records: DataFrame, least: float) -> DataFrame:
    """id, lot, plate, ts, active_id, turn, entry_ts, sim, outcome of every exit; records: as ``in_turn`` gives them."""
    at = folder(exits.sparkSession, "settlement")
    # an exit is a row: those with equal ids get numbers of their own, fixed by writing them
    waiting = written(exits.select("id", *KEY, "ts", "embedding").withColumn("row", F.monotonically_increasing_id()), f"{at}/exits")
    records = written(records, f"{at}/records")
    moment = F.struct("ts", "id", "row")
    done, turn = [], 0
    while True:
        turn += 1
        heads = records.where(F.col("turn") == turn).select(F.col("id").alias("active_id"), *KEY, "turn", "entry_ts", F.col("embedding").alias("face"))
        rows = waiting.join(heads, KEY, "left").withColumn("sim", F.round(cosine("embedding", "face"), 6)).drop("face")
        there = F.coalesce(F.col("entry_ts") <= F.col("ts"), F.lit(False))
        outcome = F.when(~there, "not_found").when(F.col("sim") >= least, "matched").otherwise("mismatch")
        judged = written(rows.withColumn("outcome", outcome).withColumn("open", F.col("active_id").isNotNull()), f"{at}/judged-{turn}")
        taken = judged.where("outcome = 'matched'").groupBy(*KEY).agg(F.min(moment).alias("taken"))
        told = judged.join(taken, KEY, "left").withColumn("late", F.coalesce(moment > F.col("taken"), F.lit(False)))
        done.append(told.where("NOT late").drop("embedding", "row", "taken", "late", "open"))
        waiting = written(told.where("late").select("id", *KEY, "ts", "embedding", "row"), f"{at}/waiting-{turn}")
        if waiting.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, done)
    found = F.col("outcome") != "not_found"
    blank = [F.when(found, F.col(c)).alias(c) for c in ("active_id", "turn", "entry_ts", "sim")]
    return rows.select("id", *KEY, "ts", *blank, "outcome")


def exit_settlement(exits: DataFrame, active: DataFrame, least: float = 0.05) -> DataFrame:
    """id, lot, plate, active_id, outcome (matched, mismatch, not_found), sim, and of a match its session: entry_ts, exit_ts, duration_min (whole minutes), match_conf."""
    rows = settled(exits, in_turn(active), least)
    matched = F.col("outcome") == "matched"
    minutes = F.expr("CAST(timestampdiff(MICROSECOND, entry_ts, ts) DIV 60000000 AS BIGINT)")
    session = [F.when(matched, c).alias(n) for c, n in ((F.col("entry_ts"), "entry_ts"), (F.col("ts"), "exit_ts"), (minutes, "duration_min"), (F.col("sim"), "match_conf"))]
    return rows.select("id", *KEY, "active_id", "outcome", "sim", *session)


def still_active(exits: DataFrame, active: DataFrame, least: float = 0.05) -> DataFrame:
    """id, lot, plate, entry_ts of the records that no exit has taken."""
    records = in_turn(active)
    gone = settled(exits, records, least).where("outcome = 'matched'").select(*KEY, "turn")
    return records.join(gone, [*KEY, "turn"], "left_anti").select("id", *KEY, "entry_ts")
