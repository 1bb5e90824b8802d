import pytest

from gatelens.operators import admission, folds, identity
from gatelens.sources import files
from gatelens.sources.views import view
from gatelens.streaming import jobs

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_full_comes_before_duplicate(spark):
    events = spark.createDataFrame([(1, 0, "A", 1, "entry"), (2, 0, "A", 2, "entry"), (3, 0, "B", 3, "entry"), (4, 0, "A", 4, "exit"), (5, 0, "B", 5, "entry")], "event_id long, lot long, plate string, at long, kind string").selectExpr("event_id", "lot", "plate", "timestamp_micros(at) AS ts", "kind")
    assert rows(admission.admission(events, 1)) == [(1, 0, 1), (2, 0, -1), (3, 0, -1), (5, 0, 5)]
    assert rows(admission.admission(events, 2)) == [(1, 0, 1), (2, 0, -2), (3, 0, 3), (5, 0, -2)]


def test_gate_admits_clears_and_lets_out():
    gate = folds.Gate(rest=10)
    face = [1.0, 0.0]
    ask = lambda e, ts, kind="entry", f=face: gate.step((e, 0, ts, 7, kind, "99B1-25739", 0.5, f))
    assert [ask(1, 1), ask(2, 2), ask(3, 3)] == [None, None, (3, 0, "99B1-25739", 3)]
    assert ask(4, 5) is None and gate.lanes["7"]["votes"] == []  # at rest
    assert [ask(5, 20), ask(6, 21), ask(7, 22)][-1] == (7, 0, "99B1-25739", -2)
    gate = folds.Gate(rest=10, held=gate.dump())
    assert ask(8, 23, "exit", [0.0, 1.0])[3] == 3 and not gate.inside


def test_stream_of_several_batches_equals_batch(spark):
    frames = view(spark, SF, "v_gate_frames")
    both = folds.fold(folds.gate_rows(frames), "lot", lambda: folds.Gate().step, folds.GATE_ROWS)
    want = rows(both)
    assert want and rows(jobs.stream_gate(frames, files=3)) == want
    assert len(want) == folds.entry_pipeline_batch(frames).count() + folds.exit_pipeline_batch(frames).count()


def test_clear_empties_the_votes(spark):
    reads = spark.createDataFrame([(1, 1, 1, "A", None), (2, 1, 2, "A", None), (3, 1, 3, "", "clear"), (4, 1, 4, "A", None), (5, 1, 5, "A", None), (6, 1, 6, "A", None)], "event_id long, lane long, ts long, raw string, control string")
    assert rows(jobs.stream_vote(reads, files=2)) == [(1, 1, None), (2, 1, None), (4, 1, None), (5, 1, None), (6, 1, "A")]


def test_streams_over_several_batches(spark):
    reads, events = view(spark, SF, "v_reads"), view(spark, SF, "v_gate")
    assert rows(jobs.stream_latest(reads, files=3)) == rows(jobs.stream_latest(reads))
    assert rows(jobs.stream_occupancy(events, files=3)) == rows(jobs.stream_occupancy(events))


def test_counted_streams_over_several_batches(spark):
    reads, modes, faces = view(spark, SF, "v_reads"), view(spark, SF, "v_mode_reads"), view(spark, SF, "v_face_vectors")
    assert rows(jobs.stream_fps(reads, files=3)) == rows(jobs.stream_fps(reads))
    assert rows(jobs.stream_mode_reset(modes, files=4)) == rows(jobs.stream_mode_reset(modes))
    assert rows(jobs.stream_embedding_avg(faces, files=3)) == rows(jobs.stream_embedding_avg(faces))


def test_source_reads_each_event_once(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    got = rows(jobs.stream_gate_source(spark, str(tmp_path), files=2))
    assert len(got) == events.where("event_type <> 'error'").count() and got == rows(jobs.stream_gate_source(spark, SF))


def test_clear_empties_the_gate():
    gate = folds.Gate(rest=10)
    ask = lambda e, ts, kind="entry": gate.step((e, 0, ts, 7, kind, "99B1-25739", 0.5, [1.0, 0.0]))
    assert [ask(1, 1), ask(2, 2), ask(3, 3, "clear"), ask(4, 4), ask(5, 5)] == [None] * 5 and ask(6, 6) == (6, 0, "99B1-25739", 6)
    assert ask(7, 7, "clear") is None and list(gate.inside) == ["99B1-25739"]


def test_cluster_must_name_its_shared_folder():
    class Session:
        conf = {"spark.master": "spark://host:7077"}

    with pytest.raises(ValueError, match="checkpoint"):
        jobs.folder(Session, "x")


def test_label_files(spark, tmp_path):
    (tmp_path / "a.1.txt").write_text("7 0.5 0.5 0.1 0.2\nx 1 2 3 4\n\n36 1 1 1 1\n35 0.1 0.2 0.3 0.4 0.9")
    (tmp_path / "b.txt").write_text("")
    got = rows(files.box_labels(files.label_lines(spark, str(tmp_path))))
    assert got == [("a.1", 1, 7, "7", 0.5, 0.5, 0.1, 0.2), ("a.1", 5, 35, "Z", 0.1, 0.2, 0.3, 0.4)]
    (tmp_path / "b.txt").write_text("image,text\nx.jpg\t30a-1\nx.jpg,30A 2\nbad")
    truth = files.text_truth(files.label_lines(spark, str(tmp_path / "b.txt")))
    assert rows(truth) == [("x.jpg", "x", "30A2")]


def test_bounded_percentiles(spark):
    timing = spark.range(10_001).selectExpr("'s' AS stage", "cast(id AS double) AS ms")
    exact, near = (identity.latency_summary(timing, accuracy=a).first() for a in (None, 1000))
    assert exact.n == near.n and all(abs(exact[c] - near[c]) <= 15 for c in ("p50", "p95", "p99"))


def test_gate_in_slices_of_time_equals_one_walk(spark):
    import random

    from gatelens.operators import folds

    rng = random.Random(3)
    rows = [(i, rng.randrange(2), 1_000_000 * (i // 2), rng.randrange(4), rng.choice(["entry", "exit"]), f"P{rng.randrange(3)}" if rng.random() < 0.8 else "", rng.choice([None, 0.2, 0.9]), [rng.random() for _ in range(3)]) for i in range(600)]
    rows += [(900 + i, 7, 1_000_000 * i, None, "entry", "P1", 0.5, [1.0, 0.0, 0.0]) for i in range(4)]  # a lot that sends nothing more
    frames = spark.createDataFrame(rows, "event_id long, lot long, ts long, lane long, kind string, plate string, quality double, embedding array<float>")
    lots: dict = {}
    want = [a for r in sorted(rows, key=lambda r: (r[2], r[0])) if (a := lots.setdefault(r[1], folds.Gate(2)).step(r)) is not None]
    for most in (25, 10_000):
        found, held = folds.gate_slices(frames.repartition(3), folds.folder(spark, "test"), 2, most=most)
        assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 100
        assert {r.lot for r in held.collect()} == {0, 1, 7}


def test_lots_busy_at_different_times_are_cut_each_by_itself(spark, tmp_path):
    """100 rows of lot 1, then 60 of lot 2: no slice may have many more than 20 rows of a lot, though all its rows lie in a part of the whole time."""
    kinds = lambda i: "entry" if i // 4 % 2 == 0 else "exit"
    seen = [(i, 1 + (i >= 100), 1_000_000 * i, 5, kinds(i), "P1", 0.5, [1.0, 0.0]) for i in range(160)] + [(200 + i, 3, 7_000_000 * i, 5, kinds(i), "P1", 0.5, [1.0, 0.0]) for i in range(18)]
    frames = spark.createDataFrame(seen, "event_id long, lot long, ts long, lane long, kind string, plate string, quality double, embedding array<float>")
    lots: dict = {}
    want = [a for r in sorted(seen, key=lambda r: (r[2], r[0])) if (a := lots.setdefault(r[1], folds.Gate(2)).step(r)) is not None]
    before = spark.createDataFrame([(9, folds.Gate(2).dump())], "lot long, held string")
    found, held = folds.gate_slices(frames, f"file://{tmp_path}/at", 2, before, most=20)
    assert rows(found) == sorted(want, key=repr) and {r.lot: r.held for r in held.collect()} == {k: g.dump() for k, g in lots.items()} | {9: folds.Gate(2).dump()}
    sizes = spark.read.parquet(f"file://{tmp_path}/at/slices").groupBy("slice", "lot").count().collect()
    assert max(r["count"] for r in sizes) <= 25 and sum(r["count"] for r in sizes) == len(seen)


def test_state_of_a_lot_is_no_row_that_grows_with_its_lanes(spark, tmp_path):
    import json

    seen = [(i, 1, 1_000_000 * i, i % 3000, "entry", f"P{i % 3000}", 0.5, [1.0, 0.5]) for i in range(6000)]
    frames = spark.createDataFrame(seen, "event_id long, lot long, ts long, lane long, kind string, plate string, quality double, embedding array<float>")
    held = folds.gate_slices(frames, f"file://{tmp_path}/at", 2, most=2500)[1].collect()
    lanes = [json.loads(r.held)[1] for r in held]
    assert max(map(len, lanes)) <= 1000 and sorted(int(x) for own in lanes for x in own) == list(range(3000))
    assert all(len(at["votes"]) == len(at["faces"]) == 2 for own in lanes for at in own.values())


def test_lanes_with_states_of_their_own_equal_one_walk_over_batches(spark, tmp_path):
    import json
    import random

    rng = random.Random(8)
    kinds, plates = ["entry"] * 5 + ["exit"] * 5 + ["clear"], ["P1", "P2", "P3", "P4"]
    here = lambda i: rng.randrange(12) if i // 200 % 2 else rng.randrange(6, 30)  # noqa: E731  # lanes that send nothing for a while
    rows_of = [(i, rng.randrange(2), 1_000_000 * (i // 3), rng.choice([None, here(i), here(i)]), rng.choice(kinds) if i % 40 == 0 else rng.choice(kinds[:-1]), rng.choice([*plates, ""]), rng.choice([None, 0.2, 0.9]), [rng.random() - 0.4 for _ in range(3)]) for i in range(1500)]
    frames = lambda part: spark.createDataFrame(part, "event_id long, lot long, ts long, lane long, kind string, plate string, quality double, embedding array<double>").repartition(3)
    lots: dict = {}
    want = [a for r in rows_of if (a := lots.setdefault(r[1], folds.Gate(2)).step(r)) is not None]
    got, held = [], None
    for n, (low, high) in enumerate([(0, 700), (700, 705), (705, 1500)]):
        found, held = folds.gate_slices(frames(rows_of[low:high]), f"file://{tmp_path}/{n}", 2, held, most=60, lanes=3)
        got += map(tuple, found.collect())
    assert sorted(got) == sorted(want) and len({a[3] for a in want if a[3] < 0}) == 4 and any(a[0] == a[3] for a in want)
    ends: dict = {}
    for r in sorted(held.collect(), key=lambda r: r.lane is not None):
        ends.setdefault(r.lot, folds.Gate(2)).take(r.held)
    full = lambda gates: {lot: json.loads(g.dump()) for lot, g in gates.items()}
    assert full(ends) == full(lots)
