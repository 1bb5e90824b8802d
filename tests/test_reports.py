"""Percentiles by narrowing, rows taken out with their dependents, batches committed once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelens.operators import evaluate, identity, percentiles, reports
from gatelens.sources import files
from gatelens.sources.views import view


@pytest.mark.parametrize("bins", [4, 1024])
def test_percentiles_equal_sorting(spark, bins):
    rng = random.Random(bins)
    groups = {"a": [rng.gauss(0, 1) for _ in range(500)], "b": [1.0] * 300 + [2.0], "c": [1e-300, 1.7e308, -1.7e308, 5.0], "d": [7.5], None: [float(rng.randint(0, 3)) for _ in range(40)]}
    data = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None), ("a", float("nan"))]
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = percentiles.exact_percentiles(spark.createDataFrame(data, "k string, v double"), F.col("k"), F.col("v"), shares, bins).collect()
    assert {r.key for r in got} == set(groups)
    for r in got:
        if r.key != "c":
            assert np.allclose(r.cuts, np.quantile(groups[r.key], shares), rtol=1e-12) and r.n == len(groups[r.key])
        else:
            assert [r.cuts[i] for i in (0, 2, 4)] == [-1.7e308, 2.5, 1.7e308]


def test_latency_of_empty_and_null_stages(spark):
    rows = identity.latency_summary(spark.createDataFrame([("a", None), (None, 2.0), (None, 4.0)], "stage string, ms double")).collect()
    assert {(r.stage, r.n, r.p50) for r in rows} == {("a", 0, None), (None, 2, 3.0)}
    assert identity.latency_summary(spark.createDataFrame([], "stage string, ms double")).count() == 0


def test_dependents_go_with_their_truth(spark):
    truth = spark.createDataFrame([(1, "29A123456"), (2, "29A1234"), (3, None), (1, "x")], "id long, text string")
    dependent = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r"), (None, "s"), (9, "t")], "id long, name string")
    kept = reports.pattern_exclude(truth, {"images": dependent})
    assert sorted(r.id for r in kept["truth"].collect()) == [2, 3] and sorted(r.name for r in kept["images"].collect()) == ["r", "s", "t"]
    assert {tuple(r) for r in reports.pattern_exclude_counts(truth, {"images": dependent}).collect()} == {("truth", 2, 2), ("images", 2, 3)}


def test_a_killed_and_repeated_batch_leaves_each_row_once(spark, tmp_path):
    batch = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    path, read = f"file://{tmp_path}/sink", lambda: sorted(r.id for r in files.committed(spark, path, batch(1).schema).collect())
    assert read() == []
    files.commit(batch(1, 2), path, 0)
    batch(3).write.parquet(f"{path}/data/batch=1")  # killed before the ledger was written
    assert read() == [1, 2]
    files.commit(batch(3, 4), path, 1)
    files.commit(batch(3, 4), path, 1)
    files.commit(batch(1, 2), path, 0)
    files.commit(batch(), path, 2)
    assert read() == [1, 2, 3, 4]


def test_lines_left_out_are_counted_in_the_pass_that_reads_the_rest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 0.5 0.5 0.1 0.1\n\n7 0.5\nx 0.5 0.5 0.1 0.1\n36 0.5 0.5 0.1 0.1\n2 0.5 zero 0.1 0.1\n3 .1 .2 .3 .4 extra\n   ")
    lines = files.label_lines(spark, f"file://{tmp_path}/*.txt")
    labels, counts = files.observed_labels(lines)
    assert sorted(r.line_no for r in labels.collect()) == [1, 7]
    assert counts.get == {"kept": 2, "blank": 2, "short": 1, "unparsable": 2, "class": 1}
    assert {r.status: r.n for r in files.label_line_counts(lines).collect()} == counts.get
    null = spark.createDataFrame([("s", 1, None)], "stem string, line_no long, line string")
    assert files.box_labels(null).count() == 0 and [tuple(r) for r in files.label_line_counts(null).collect()] == [("blank", 1)]


def test_truth_lines_by_what_is_wrong_with_them(spark):
    lines = ["image,text", "a.jpg\tAB 1", "", None, "nothing here", ",X", "b.jpg,c", "image,text"]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines, 1)], "line_no long, line string")
    assert {r.status: r.n for r in files.truth_line_counts(df).collect()} == {"header": 1, "read": 3, "blank": 2, "unsplit": 1, "nameless": 1}
    assert {(r.name, r.text) for r in files.text_truth(df).collect()} == {("a.jpg", "AB1"), ("b.jpg", "C"), ("image", "TEXT")}


def test_wrong_matches_have_both_origins(spark):
    tables = [view(spark, "/root/testdata/sf0.001", v) for v in ("v_samples", "v_earlier")]
    rows = evaluate.wrong_match_origin(*tables).collect()
    assert {r.origin for r in rows} == {"earlier", "own"} and all((r.matched_rid < 0) == (r.origin == "earlier") for r in rows)
    one = evaluate.wrong_match_counts(*tables).first()
    assert one.n == len(rows) == one.by_earlier + one.by_own and one.covered == sum(r.gap is not None and r.gap > 0 for r in rows)


def test_evaluations_read_the_samples_once(spark):
    from pyspark.sql import functions as F

    from gatelens.operators import evaluate

    seen = spark.sparkContext.accumulator(0)

    def counted(i):
        seen.add(1)
        return i

    mark = F.udf(counted, "long").asNondeterministic()
    rows = [(i, f"29A{10000 + i // 4}", 1, [1.0, i % 3 - 1.0], f"29A{10000 + i // 4}", 1, [i % 5 - 2.0, 1.0]) for i in range(40)]
    samples = spark.createDataFrame(rows, "i long, entry_raw string, entry_faces int, gallery array<double>, exit_raw string, exit_faces int, probe array<double>")
    earlier = samples.select((-1 - F.col("i")).alias("id"), F.col("entry_raw").alias("raw"), "gallery")
    samples = samples.withColumn("i", mark("i"))
    for job in (lambda s: evaluate.below_thr_profile(evaluate.paired_eval(s)), evaluate.wrong_match_report, lambda s: evaluate.wrong_match_counts(s, earlier)):
        before = seen.value
        assert job(samples).collect()
        assert seen.value - before == 40


def test_excluded_sets_are_counted_by_id_without_a_join(spark):
    """A join sorted every row of a set in its tasks' memory."""
    reads = spark.createDataFrame([(1, "12A345678"), (2, "x"), (3, None), (None, "12A345678"), (5, "y")], "event_id long, pred string")
    chars = spark.createDataFrame([(1,), (2,), (2,), (None,), (9,)], "crop_id long")
    boxes = spark.createDataFrame([(1,), (1,), (3,)], "frame_id long")
    truth, sets = reports.excluded_sets(reads, chars, boxes, boxes)
    kept = reports.pattern_exclude(truth, sets)
    want = sorted([(name, r.id, r["count"]) for name, rows in kept.items() for r in rows.groupBy("id").count().collect()], key=repr)
    found = reports.excluded_rows(reads, chars, boxes, boxes)
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    counts = {r.part: (r.removed, r.kept) for r in reports.excluded_counts(reads, chars, boxes, boxes).collect()}
    assert counts == {name: (rows.count() - kept[name].count(), kept[name].count()) for name, rows in {"truth": truth, **sets}.items()}
