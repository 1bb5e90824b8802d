import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelens.operators import angles, search


def vectors(spark, n=60, identities=4, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(i, i % identities, m[i].tolist()) for i in range(n)]
    return m, spark.createDataFrame(rows + [(n, 0, None)], "id long, identity long, embedding array<double>")


def test_blocks_give_the_same_pairs_as_one_product(spark):
    m, df = vectors(spark)
    want = {(i, j) for i in range(60) for j in range(60) if m[i] @ m[j] >= 0.5}
    assert {(r.a, r.b) for r in search.matched(df, df, search.over(0.5), size=7).collect()} == want
    found = search.ranked(search.matched(df, df, search.best(3), size=7), 3).collect()
    assert {(r.a, r.b) for r in found} == {(i, int(j)) for i in range(60) for j in np.argsort(-(m @ m[i]))[:3]}


def clustered(spark, n, clusters, seed, spread=0.05, dims=8, first=0):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(clusters, dims))
    m = centres[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, dims))
    m[:2] = 0  # no angle
    m[2:6] = m[2]
    return m, spark.createDataFrame([(first + i, i, m[i].tolist()) for i in range(n)] + [(first + n, 0, None)], "id long, identity long, embedding array<double>")


@pytest.mark.parametrize("clusters, spread", [(12, 0.05), (1, 3.0)])
def test_the_metric_index_is_exact(spark, monkeypatch, clusters, spread):
    monkeypatch.setattr(angles, "ROWS_EACH", 5)
    x, exits = clustered(spark, 150, clusters, 1, spread)
    g, active = clustered(spark, 300, clusters, 2, spread, first=1000)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    sims = np.round(unit(x) @ unit(g).T, 6) + 0.0
    for k, least in ((3, 0.15), (2, -2.0), (400, 0.5)):
        want = [(i, at, 1000 + int(j), sims[i, j]) for i in range(150) for at, j in enumerate(np.lexsort((np.arange(300), -sims[i]))[:k], 1) if sims[i, j] >= least]
        got = search.ranked(search.near(exits, active, search.best(k), k, least, size=16), k).where(F.col("sim") >= least).collect()
        assert sorted((r.a, r["rank"], r.b) for r in got) == sorted(w[:3] for w in want)
        assert np.allclose([r.sim for r in sorted(got, key=lambda r: (r.a, r["rank"]))], [w[3] for w in want], atol=2e-6)
    pairs = {(r.id, r.active_id) for r in search.cross_similarity(exits, active, 0.9).collect()}
    assert pairs == {(int(i), 1000 + int(j)) for i, j in zip(*np.nonzero(sims >= 0.9))}


def test_the_metric_index_drops_most_pairs_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(angles, "ROWS_EACH", 5)
    _, exits = clustered(spark, 300, 40, 1)
    _, active = clustered(spark, 800, 40, 2, first=1000)
    a, b = angles.routes(exits, active, search.best(3), 3, 0.15, 64)
    blocks = a.groupBy("c", "i", "d", "j").agg(F.count("*").alias("x")).join(b.groupBy("c", "i", "d", "j").agg(F.count("*").alias("y")), ["c", "i", "d", "j"])
    assert blocks.agg(F.sum(F.col("x") * F.col("y"))).first()[0] < 0.5 * 300 * 800


def test_vectors_without_clusters_take_plain_blocks(spark):
    _, exits = clustered(spark, 300, 1, 1, 3.0)
    assert angles.routes(exits, exits, search.best(3), 3, -2.0, 64) is None


def test_pruning_leaves_no_bad_pair_and_follows_the_greedy_rule(spark):
    m, df = vectors(spark)
    got = {r.id: r.reason for r in search.outlier_prune(df, -0.3).collect()}
    gone = []
    assert {r.id: r.reason for r in search.outlier_prune(df, -0.3, bound=20).collect()} == got  # turns in Spark rounds first
    for identity in range(4):
        alive = list(range(identity, 60, 4))
        while True:
            bad = {i: sum(m[i] @ m[j] <= -0.3 for j in alive if j != i) for i in alive}
            top = max(bad.values())
            if not top:
                break
            tied = [i for i in alive if bad[i] == top]
            victim = min(tied, key=lambda i: (np.mean([m[i] @ m[j] for j in alive if j != i]), i))
            gone.append(victim)
            alive.remove(victim)
    assert sorted(got) == sorted(gone)


def test_opposite_halves_of_an_identity_go_in_rounds(spark):
    df = spark.createDataFrame([(i, 1, [1.0 if i % 2 else -1.0, i / 1000]) for i in range(20)], "id long, identity long, embedding array<double>")
    want = sorted((r.id, r.reason) for r in search.outlier_prune(df).collect())
    assert want == sorted((r.id, r.reason) for r in search.outlier_prune(df, bound=1).collect()) and len(want) == 10


def test_two_images_that_differ_go_together(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [-1.0, 0.0]), (3, 2, [1.0, 0.0])], "id long, identity long, embedding array<double>")
    assert sorted((r.id, r.reason) for r in search.outlier_prune(df).collect()) == [(1, "both"), (2, "both")]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, identity long, embedding array<double>")
    assert search.topk_similar(empty, empty).count() == 0 and search.outlier_prune(empty).count() == 0


def test_turns_over_a_bound_take_one_job_not_a_round_each(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, 1, [float(x) for x in rng.normal(size=4)]) for i in range(150)], "id long, identity long, embedding array<double>")
    want = sorted(map(tuple, search.outlier_prune(df).collect()))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("prune"))
    spark.sparkContext.setJobGroup("prune", "turns")
    try:
        got = sorted(map(tuple, search.outlier_prune(df, bound=100).collect()))
        assert len(got) > 50 and jobs() < 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want
