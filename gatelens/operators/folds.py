"""Folds over the events of a lot or lane in time order, where each answer depends on the answers before it.

Rows are dealt by the key and sorted within partitions; a task streams through them and holds only the state of the key
at hand (for a lot at most ``capacity`` vehicles and a few reads of the lanes at hand), never the key's rows. A key's answers depend on each
other, so a key is one task's work. Rows with a null key or time are left out; equal times are ordered by event_id."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import folder, written
from .evaluate import plate_of

#: A row's answer, or None for no answer.
Step = Callable[[tuple], tuple | None]


def fold(rows: DataFrame, key: str, fresh: Callable[[], Step], schema: str) -> DataFrame:
    """The answers of ``fresh()`` to the rows of each key, in order. The first columns of the rows are event_id, key, ts."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = step = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if step is None or row[1] != last:
                    last, step = row[1], fresh()
                if (answer := step(row)) is not None:
                    out.append(answer)
            yield pd.DataFrame(out, columns=names)

    dealt = rows.dropna(subset=[key, "ts"]).repartition(key).sortWithinPartitions(key, "ts", "event_id")
    return dealt.mapInPandas(run, schema)


def cooldown_suppress(reads: DataFrame, seconds: int = 86_400) -> DataFrame:
    """event_id, lane of the accepted rows: those that come ``seconds`` or more after the last accepted one of the lane."""

    def fresh() -> Step:
        until = None

        def step(row: tuple) -> tuple | None:
            nonlocal until
            if until is not None and row[2] < until:
                return None
            until = row[2] + seconds * 1_000_000
            return row[0], row[1]

        return step

    return fold(reads.select("event_id", "lane", micros("ts")), "lane", fresh, "event_id long, lane long")


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")).alias("ts")


class Gate:
    """One lot: votes and faces of each lane, vehicles inside. Success clears the lane and lets it rest for ``rest`` microseconds."""

    def __init__(self, capacity: int = 500, rest: int = 2_000_000, least: float = 0.05, held: str | None = None):
        self.capacity, self.rest, self.least = capacity, rest, least
        self.inside, self.lanes, self.cleared = {}, {}, 0
        if held:
            self.take(held)

    def dump(self) -> str:
        return json.dumps((self.inside, {name: packed(at) for name, at in self.lanes.items()}, self.cleared))

    def give(self, lane: str) -> str:
        """The state of one lane, which this gate then no longer has."""
        return json.dumps(({}, {lane: packed(self.lanes.pop(lane))}, self.cleared))

    def take(self, held: str) -> None:
        """What ``dump`` or ``give`` gave; a lane that was away when its lot was cleared is cleared now."""
        inside, lanes, cleared = json.loads(held)
        self.inside |= inside
        self.cleared = max(self.cleared, cleared)
        for name, at in lanes.items():
            self.lanes[name] = unpacked(at) | ({} if cleared == self.cleared else {"votes": [], "faces": []})

    def stable(self, votes: list[str]) -> str | None:
        """The oldest of the most frequent reads if there are three reads and it holds half of them."""
        top = max(votes, key=lambda v: (votes.count(v), -votes.index(v)))
        return top if len(votes) >= 3 and 2 * votes.count(top) >= len(votes) else None

    @staticmethod
    def mean(faces: list) -> list[float]:
        q = np.array([max(f[0], 0.01) for f in faces])
        m = (q / q.sum()) @ np.array([f[1] for f in faces], dtype=float)
        return (m / n if (n := np.linalg.norm(m)) > 0 else m).tolist()

    def step(self, row: tuple) -> tuple | None:
        """event_id, lot, plate, code: the entry's event_id, or the record that leaves for an exit; -1 full, -2 inside already,
        -3 not inside, -4 another face."""
        event, lot, ts, lane, kind, plate, quality, face = row
        if kind == "clear":
            self.lanes = {name: at | {"votes": [], "faces": []} for name, at in self.lanes.items()}
            self.cleared += 1
            return None
        at = self.lanes.setdefault(str(lane), {"votes": [], "faces": [], "until": None})
        if at["until"] is not None and ts < at["until"]:
            return None
        if quality is not None and quality == quality and face is not None:
            own = np.array(face, dtype=np.float32 if getattr(face, "dtype", None) == np.float32 else float)  # a copy: a part of a batch would hold all of it
            at["faces"] = [*at["faces"], (float(quality), own)][-3:]
        if not plate:
            return None
        at["votes"] = [*at["votes"], plate][-5:]
        if (read := self.stable(at["votes"])) is None or not at["faces"]:
            return None
        if kind == "entry":
            if len(self.inside) >= self.capacity:
                return event, lot, read, -1
            if read in self.inside:
                return event, lot, read, -2
            self.inside[read] = (event, self.mean(at["faces"]))
            code = event
        else:
            if read not in self.inside:
                return event, lot, read, -3
            code, known = self.inside[read]
            a, b = np.array(known), np.array(self.mean(at["faces"]))
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-8) < self.least:
                return event, lot, read, -4
            del self.inside[read]
        at.update(votes=[], faces=[], until=ts + self.rest)
        return event, lot, read, code


def packed(at: dict) -> dict:
    """A lane's state for JSON, each face as the bytes of its numbers: as float where that loses nothing."""

    def text(face: np.ndarray) -> str:
        narrow = face.astype("<f4")
        same = np.array_equal(narrow.astype(float), face, equal_nan=True)
        return ("f" if same else "d") + base64.b64encode((narrow if same else face.astype("<f8")).tobytes()).decode()

    return at | {"faces": [(q, text(face)) for q, face in at["faces"]]}


def unpacked(at: dict) -> dict:
    return at | {"faces": [(q, np.frombuffer(base64.b64decode(text[1:]), "<f4" if text[0] == "f" else "<f8")) for q, text in at["faces"]]}


GATE_ROWS = "event_id long, lot long, plate string, code long"


GATE_COLUMNS = ["event_id", "lot", "ts", "lane", "kind", "plate", "quality", "embedding"]


def gate_rows(frames: DataFrame) -> DataFrame:
    """Frames as the gate takes them: event_id, lot, ts (microseconds), lane, kind, plate, quality, embedding."""
    return frames.select("event_id", "lot", micros("ts"), "lane", "kind", F.coalesce(plate_of("raw"), F.lit("")).alias("plate"), "quality", F.when(F.col("quality").isNotNull(), F.col("embedding")).alias("embedding"))  # a face without a quality is never used


#: Rows of a lot that one task reads of a slice of time, about.
SLICE = 500_000
#: Lanes that go with the state of their lot; others have a row each.
LANES = 1_000
#: The state of a lot (lane null), or of a lane that doesn't go with it.
STATES = "lot long, lane string, held string"
#: Answers (next -1) and states: the slice that needs one next, and the row (ts, event_id) it is needed at.
FOLDED = f"{GATE_ROWS}, lane string, held string, ts long, next int"
#: In the order of time, a state comes before the row at which it is needed, and a lane or lot ends behind its last row of a slice.
COMES, SEEN, ENDS = 0, 1, 2
FIRST, LAST = -(2**63), 2**63 - 1


def gate_step(rows: DataFrame, held: DataFrame | None, ends: DataFrame, capacity: int, lanes: int = LANES) -> DataFrame:
    """FOLDED of ``rows`` (gate_rows); ``held``: the states that come, as FOLDED; ``ends``: of each lane and lot (lane null) its last row (ts, event_id), and the slice (next) and
    row (due_ts, due_event) that need its state next. A task streams through its lots in the order of time. It holds one batch, the lot's vehicles, ``lanes`` lanes and those
    between their first and last rows here, so it is bounded by these rows, never by all lanes of a lot."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    unset = [F.lit(0).cast("int").alias("next"), F.lit(0).cast("long").alias("due_ts"), F.lit(0).cast("long").alias("due_event")]
    flow = rows.select(*GATE_COLUMNS, F.lit(SEEN).alias("mark"), none("string", "held"), *unset)
    flow = flow.unionByName(ends.select("event_id", "lot", "ts", "lane", F.lit(ENDS).alias("mark"), "next", "due_ts", "due_event"), allowMissingColumns=True)
    if held is not None:
        flow = flow.unionByName(held.select("event_id", "lot", "ts", "lane", "held", F.lit(COMES).alias("mark"), *unset), allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, gate = None, None
        for batch in batches:
            out = []
            for *row, mark, state, later, due_ts, due_event in batch.itertuples(index=False, name=None):
                lot, lane = row[1], row[3]
                if gate is None or lot != last:
                    last, gate = lot, Gate(capacity)
                if mark == SEEN:
                    if (answer := gate.step(tuple(row))) is not None:
                        out.append((*answer, None, None, 0, -1))
                elif mark == COMES:
                    gate.take(state)
                elif lane is None:
                    out.append((due_event, lot, None, 0, None, gate.dump(), due_ts, later))
                    gate = None
                elif len(gate.lanes) > lanes and lane in gate.lanes:
                    out.append((due_event, lot, None, 0, lane, gate.give(lane), due_ts, later))
            yield pd.DataFrame(out, columns=["event_id", "lot", "plate", "code", "lane", "held", "ts", "next"])

    dealt = flow.select(*GATE_COLUMNS, "mark", "held", "next", "due_ts", "due_event").repartition("lot").sortWithinPartitions("lot", "ts", "event_id", "mark")
    return dealt.mapInPandas(run, FOLDED)


def gate_spans(rows: DataFrame, slices: int) -> DataFrame:
    """slice, lot, lane (null: the lot itself), came (ts, event_id), and what ``gate_step`` has of ends: for each slice in which the lane or lot has rows. next: ``slices`` if in none
    behind it."""
    at = F.struct("ts", "event_id")
    lanes = rows.groupBy("slice", "lot", "lane").agg(F.min(at).alias("came"), F.max(at).alias("gone"))
    edge = lambda ts: F.struct(F.lit(ts).cast("long").alias("ts"), F.lit(0).cast("long").alias("event_id"))
    lots = rows.select("slice", "lot").distinct().select("slice", "lot", F.lit(None).cast("string").alias("lane"), edge(FIRST).alias("came"), edge(LAST).alias("gone"))
    order = W.partitionBy("lot", "lane").orderBy("slice")
    later = lanes.unionByName(lots).withColumn("next", F.coalesce(F.lead("slice").over(order), F.lit(slices))).withColumn("due", F.lead("came").over(order))
    due = [F.coalesce(f"due.{c}", F.lit(0).cast("long")).alias(name) for c, name in (("ts", "due_ts"), ("event_id", "due_event"))]
    return later.select("slice", "lot", "lane", "came", "gone.ts", "gone.event_id", "next", *due)


def gate_slices(rows: DataFrame, at: str, capacity: int, held: DataFrame | None = None, most: int = SLICE, lanes: int = LANES) -> tuple[DataFrame, DataFrame]:
    """The answers to ``rows`` (gate_rows) and the STATES behind them, of those in ``held`` too (a lot's alone, without a column lane, has all its lanes). The time of each lot with
    more than ``most`` rows is cut by itself, so that it has about as many in a slice, whenever the other lots have theirs; the slices follow each other, and each writes the states
    behind it under ``at`` for the slice that needs them next: a lot's with ``lanes`` lanes at most, and a row for each other lane. So what a task reads and holds grows neither with a
    lot's history nor with its lanes, and a state is written only where its lane has rows."""
    spark = rows.sparkSession
    rows = rows.dropna(subset=["lot", "ts"]).withColumn("lane", F.coalesce(F.col("lane").cast("string"), F.lit("None")))
    rows = written(rows.select(*GATE_COLUMNS), f"{at}/rows")
    busy = rows.groupBy("lot").count().where(F.col("count") > most)  # at most rows / most lots
    busiest, last = busy.agg(F.max("count")).first()[0], 0
    if busiest:
        slices = -(-busiest // most)
        places = F.percentile_approx("ts", [i / slices for i in range(1, slices)])
        own = rows.join(F.broadcast(busy.select("lot")), "lot").groupBy("lot").agg(places.alias("places"), F.max("ts").alias("last"))
        cuts = written(own.select("lot", F.filter(F.array_distinct("places"), lambda c: c < F.col("last")).alias("cuts")), f"{at}/cuts")  # times of rows, so every slice has some
        last = cuts.agg(F.max(F.size("cuts"))).first()[0]
    if last:
        part = F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("ts"))))
        rows.join(F.broadcast(cuts), "lot", "left").withColumn("slice", part).drop("cuts").write.partitionBy("slice").parquet(f"{at}/slices")
        rows = spark.read.schema(rows.withColumn("slice", F.lit(0)).schema).parquet(f"{at}/slices")
    else:
        rows = rows.withColumn("slice", F.lit(0))
    spans = gate_spans(rows, last + 1)
    spans.write.partitionBy("slice").parquet(f"{at}/spans")
    spans = spark.read.schema(spans.schema).parquet(f"{at}/spans")
    folded = lambda: spark.read.schema(f"{FOLDED}, slice int").parquet(f"{at}/folded")
    if held is not None:
        held = (held if "lane" in held.columns else held.withColumn("lane", F.lit(None).cast("string"))).alias("h")
        first = spans.groupBy("lot", "lane").agg(F.min(F.struct("slice", "came")).alias("first")).alias("f")
        due = held.join(first, F.col("h.lot").eqNullSafe(F.col("f.lot")) & F.col("h.lane").eqNullSafe(F.col("f.lane")), "left")
        due = due.select("h.lot", "h.lane", "held", F.coalesce("first.slice", F.lit(last + 1)).alias("next"), "first.came.ts", "first.came.event_id")
        due.write.partitionBy("next").parquet(f"{at}/folded/slice=-1")
    for i in range(last + 1):
        due = folded().where(F.col("next") == i) if i or held is not None else None
        now = gate_step(rows.where(F.col("slice") == i), due, spans.where(F.col("slice") == i), capacity, lanes)
        now.write.partitionBy("next").parquet(f"{at}/folded/slice={i}")
    found = folded()
    return found.where("next = -1").select("event_id", "lot", "plate", "code"), found.where(F.col("next") == last + 1).select("lot", "lane", "held")


def gate_batch(frames: DataFrame, capacity: int, most: int = SLICE) -> DataFrame:
    return gate_slices(gate_rows(frames), folder(frames.sparkSession, "gate"), capacity, most=most)[0]


def entry_pipeline_batch(frames: DataFrame, capacity: int = 500) -> DataFrame:
    """event_id, lot, plate, code of entries: reads and faces voted and averaged, admitted, with clearing and rest. Exits count
    as far as they make room."""
    return gate_batch(frames, capacity).where("code = event_id OR code IN (-1, -2)")


def exit_pipeline_batch(frames: DataFrame, capacity: int = 500) -> DataFrame:
    """event_id, lot, plate, code of exits: the record that leaves, -3 if the plate isn't inside, -4 if the face is another."""
    return gate_batch(frames, capacity).where("code <> event_id AND code NOT IN (-1, -2)")
