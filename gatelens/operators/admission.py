"""Admission of vehicles to lots with a limited number of places, without one task that reads a whole lot.

Without a limit a lot would hold at least the vehicles that it holds with one, since an entry adds no more and an exit takes the same plate. So
where the occupancy without a limit is below the capacity, the lot has room, and an entry depends on its own plate alone. After an exit, or
an entry that found room, a plate's state is certain: out or in. It is uncertain only from an entry of a plate that is not in for certain, at a time when
the lot may be full, to the plate's next exit or entry that finds room. While no plate is uncertain, both occupancies are equal.

The stretches in which some plate of a lot is uncertain are the congested ones. They are found with windows over plates and running sums over ranges of time;
each of them is then folded by itself, from the occupancy at its start. Everything outside is a formula. A lot that is full from its first
day to its last is one stretch, and one task's work: each of its answers depends on those before.

Rows with a null lot or time are left out; equal times are ordered by event_id; a null plate is a plate like any other; every kind but 'exit' is an entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import folder, written
from .folds import Step, fold, micros
from .ranges import Ranges


def _running(ranges: Ranges, rows: DataFrame, step: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``step`` over their lot up to and with the row; ``ranges.rows`` has to hold ``step``."""
    rows = rows.withColumn("own", F.sum(step).over(ranges.window("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)))
    rows = ranges.carried(rows, "before", F.sum(step), F.sum)
    return rows.withColumn(name, F.col("own") + F.coalesce("before", F.lit(0))).drop("own", "before")


def stays(events: DataFrame) -> DataFrame:
    """event_id, lot, ts, plate, leaves (an exit), change (of the occupancy without a limit)."""
    plates = W.partitionBy("lot", "plate").orderBy("ts", "event_id")
    leaves = F.coalesce(F.col("kind") == "exit", F.lit(False))
    rows = events.select("event_id", "lot", micros("ts"), "plate", leaves.alias("leaves")).dropna(subset=["lot", "ts"])
    was_out = F.coalesce(F.lag("leaves").over(plates), F.lit(True))
    return rows.withColumn("change", F.when(was_out == F.col("leaves"), 0).when(F.col("leaves"), -1).otherwise(1))


def occupied(events: DataFrame, capacity: int = 500, **cut) -> tuple[DataFrame, Ranges, bool]:
    """event_id, lot, ts, plate, leaves (an exit), change (of the occupancy without a limit), held (that occupancy before the event), part, written once; their
    ranges; and whether any entry may meet a full lot."""
    ranges = Ranges(stays(events), "lot", "ts", **cut)
    rows = _running(ranges, ranges.rows, "change", "held").withColumn("held", F.col("held") - F.col("change"))
    rows = written(rows, f"{folder(events.sparkSession, 'admission')}/rows")
    return rows, ranges, not rows.where(~F.col("leaves") & (F.col("held") >= capacity)).isEmpty()


def stretches(rows: DataFrame, ranges: Ranges, capacity: int = 500) -> DataFrame:
    """Of ``occupied`` event_id, lot, ts, plate, leaves, held, and known ('in', 'out', or null for an uncertain plate, before the event), stretch (number of
    the congested stretch in the lot, null outside of one)."""
    plates = W.partitionBy("lot", "plate").orderBy("ts", "event_id")
    tight = ~F.col("leaves") & (F.col("held") >= capacity)
    rows = rows.withColumn("tight", tight)
    settled = F.last(F.when(~F.col("tight"), F.col("leaves")), ignorenulls=True).over(plates.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("left", F.coalesce(settled, F.lit(True))).withColumn("loose", F.coalesce(F.lag("tight").over(plates), F.lit(False)) & F.col("left"))
    known = F.when(~F.col("left"), "in").when(~F.col("loose"), "out")
    open_ = F.when(F.col("tight") & (F.col("known") == "out"), 1).when(~F.col("tight") & F.col("loose"), -1).otherwise(0)
    ranges.rows = rows.withColumn("known", known).withColumn("open", open_)
    rows = _running(ranges, ranges.rows, "open", "opened")
    ranges.rows = rows.withColumn("starts", ((F.col("opened") > 0) & (F.col("opened") == F.col("open"))).cast("int"))
    rows = _running(ranges, ranges.rows, "starts", "stretch")
    inside = (F.col("opened") > 0) | (F.col("open") < 0)
    return rows.select("event_id", "lot", "ts", "plate", "leaves", "held", "known", F.when(inside, F.col("stretch")).alias("stretch"))


def admission(events: DataFrame, capacity: int | None = 500, **cut) -> DataFrame:
    """event_id, lot, code of every entry: its event_id if admitted, -1 if the lot is full, else -2 if the plate is in. A capacity of None is no limit."""
    rows, ranges, full = (stays(events), None, False) if capacity is None else occupied(events, capacity, **cut)
    plain = lambda rows, code: rows.where("NOT leaves").select(F.col("event_id").cast("long").alias("event_id"), F.col("lot").cast("long").alias("lot"), code.cast("long").alias("code"))
    if not full:  # every lot has room at all times
        return plain(rows, F.when(F.col("change") == 0, F.lit(-2)).otherwise(F.col("event_id")))
    rows = written(stretches(rows, ranges, capacity), f"{folder(events.sparkSession, 'admission')}/stretches")
    code = F.when(F.col("held") >= capacity, F.lit(-1)).when(F.col("known") == "in", F.lit(-2)).otherwise(F.col("event_id"))

    def fresh() -> Step:
        inside: dict[str, bool] = {}  # plates whose state is uncertain from outside
        taken = None

        def step(row: tuple) -> tuple | None:
            nonlocal taken
            event, _, _, lot, plate, leaves, held, known = row
            if taken is None:
                taken = held
            is_in = inside[plate] if known is None else known == "in"
            if leaves:
                taken -= is_in
                inside.pop(plate, None)
                return None
            code = -1 if taken >= capacity else -2 if is_in else event
            if code == event:
                taken, is_in = taken + 1, True
            if held >= capacity and known != "in":
                inside[plate] = is_in
            else:
                inside.pop(plate, None)
            return event, lot, code

        return step

    congested = rows.where("stretch IS NOT NULL").select("event_id", F.concat_ws(":", "lot", "stretch").alias("key"), "ts", "lot", "plate", "leaves", "held", "known")
    return plain(rows.where("stretch IS NULL"), code).unionByName(fold(congested, "key", fresh, "event_id long, lot long, code long"))
