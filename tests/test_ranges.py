"""Windows of long keys cut into ranges, and records settled once, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from gatelens.operators import gates, identity, ranges, reports, settlement

CUT = {"share": 0.1, "least_rows": 0}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def events(spark):
    """One lot and lane with most rows, ties in time, a few small ones, one without a name."""
    rng = random.Random(4)
    data = []
    for i in range(4000):
        lane = rng.choice([1] * 8 + [2, 3, None])
        raw = rng.choice(["A", "B", "C", ""])
        data.append((i, lane, f"P{rng.randint(0, 40)}", rng.randint(0, 3000), rng.choice(["entry", "exit"]), raw, rng.choice([0, 0, 1]), rng.choice([None, 0.5, 0.9]), [rng.random(), rng.random()]))
    df = spark.createDataFrame(data, "event_id long, lane long, plate string, at long, kind string, raw string, n_faces int, quality double, embedding array<double>")
    return df.withColumn("ts", F.expr("timestamp_micros(at * 1000000)").cast("timestamp_ntz")).withColumn("lot", F.col("lane")).withColumn("image_id", F.col("event_id")).drop("at")


@pytest.mark.parametrize("run", [gates.occupancy_timeline, gates.plate_vote, gates.frame_sample, lambda e, **c: reports.asof_frames(e, e, **c), identity.embedding_avg])
def test_long_keys_in_ranges_give_the_same_rows(events, run):
    assert rows(run(events, **CUT)) == rows(run(events))


def test_ranges_of_a_hot_key_are_even_and_small_keys_are_whole(events):
    cut = ranges.Ranges(events, "lane", "ts", **CUT).rows.groupBy("lane", "part").count().collect()
    hot = [r["count"] for r in cut if r.lane == 1]
    assert len(hot) > 50 and max(hot) < 4 * sum(hot) / len(hot)
    assert {r.lane for r in cut if r.part > 0} == {1}


def test_one_lot_of_a_million_events(spark):
    n = 1_000_000
    events = spark.range(n).select(F.col("id").alias("event_id"), F.lit(1).alias("lot"), F.concat(F.lit("P"), F.floor(F.col("id") / 2)).alias("plate"), F.expr("timestamp_seconds(id)").cast("timestamp_ntz").alias("ts"), F.when(F.col("id") % 2 == 0, "entry").otherwise("exit").alias("kind"))
    parts = ranges.Ranges(gates.accepted(events), "lot", "ts").rows.groupBy("part").count().collect()
    assert len(parts) == ranges.RANGES and max(r["count"] for r in parts) < n / 40
    wrong = gates.occupancy_timeline(events).where(F.col("occupancy") != F.when(F.col("event_id") % 2 == 0, 1).otherwise(0))
    assert wrong.count() == 0


RECORDS, EXITS = "id long, lot int, plate string, entry_ts int, embedding array<double>", "id long, lot int, plate string, ts int, embedding array<double>"
UP, DOWN = [1.0, 0.0], [0.0, 1.0]


def at(df, c):
    return df.withColumn(c, F.expr(f"timestamp_seconds({c})").cast("timestamp_ntz"))


def settle(spark, exits, records):
    x, r = at(spark.createDataFrame(exits, EXITS), "ts"), at(spark.createDataFrame(records, RECORDS), "entry_ts")
    got = {(e.id, e.active_id, e.outcome, e.duration_min) for e in settlement.exit_settlement(x, r).collect()}
    return got, sorted(e.id for e in settlement.still_active(x, r).collect())


def test_two_exits_of_one_record_settle_it_once(spark):
    got, left = settle(spark, [(1, 0, "P", 600, UP), (2, 0, "P", 700, UP), (3, 1, "P", 700, UP)], [(9, 0, "P", 0, UP)])
    assert got == {(1, 9, "matched", 10), (2, None, "not_found", None), (3, None, "not_found", None)} and left == []


def test_a_face_that_fails_leaves_the_record_to_the_next(spark):
    got, left = settle(spark, [(1, 0, "P", 60, DOWN), (2, 0, "P", 120, UP), (3, 0, "P", 180, DOWN), (4, 0, "P", 5, UP), (5, 0, None, 9, UP), (6, 0, "P", 240, None)], [(8, 0, "P", 10, UP), (9, 0, "P", 20, DOWN), (10, 0, "P", 200, DOWN), (11, 0, "Q", 0, None)])
    assert got == {(4, None, "not_found", None), (1, 8, "mismatch", None), (2, 8, "matched", 1), (3, 9, "matched", 2), (5, None, "not_found", None), (6, 10, "mismatch", None)}
    assert left == [10, 11]


def test_settlement_equals_a_walk(spark):
    rng = random.Random(2)
    face = lambda: rng.choice([UP, DOWN, [0.6, 0.8], None])
    records = [(i, rng.randint(0, 1), f"P{rng.randint(0, 5)}", rng.randint(0, 50), face()) for i in range(60)]
    exits = [(i % 110, rng.randint(0, 1), f"P{rng.randint(0, 5)}", rng.randint(0, 90), face()) for i in range(120)]
    held, want = {}, []
    for r in sorted(records, key=lambda r: (r[3], r[0])):
        held.setdefault(r[1:3], []).append(r)
    for e in sorted(exits, key=lambda e: (e[3], e[0])):
        queue = held.get(e[1:3], [])
        if not queue or queue[0][3] > e[3]:
            want.append((e[0], None, "not_found"))
            continue
        sim = sum(x * y for x, y in zip(queue[0][4], e[4])) if queue[0][4] and e[4] else None
        want.append((e[0], queue[0][0], "matched" if sim is not None and sim >= 0.05 else "mismatch"))
        if want[-1][2] == "matched":
            queue.pop(0)
    x, r = at(spark.createDataFrame(exits, EXITS), "ts"), at(spark.createDataFrame(records, RECORDS), "entry_ts")
    got = [(e.id, e.active_id, e.outcome) for e in settlement.exit_settlement(x, r).collect()]
    # rows under an equal id and time may change places
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sorted(e.id for e in settlement.still_active(x, r).collect()) == sorted(r[0] for q in held.values() for r in q)
    assert settlement.exit_settlement(x.limit(0), r).count() == 0 and settlement.still_active(x.limit(0), r).count() == 60
