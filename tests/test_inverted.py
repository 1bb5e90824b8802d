import numpy as np
import pytest

from gatelens.operators import inverted, search
from gatelens.sources.shared import written
from gatelens.sources.views import view

from .test_search import clustered


def recall(exits, active, **options):
    exact = {(r.id, r.active_id) for r in search.topk_similar(exits, active, least=-1.0).collect()}
    near = {(r.id, r.active_id) for r in inverted.ivf_topk(exits, active, **options).collect()}
    return len(exact & near) / len(exact)


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall_on_the_tables(spark, sf):
    exits, active = (view(spark, f"/root/testdata/sf{sf}", v) for v in ("v_exit", "v_active"))
    assert recall(exits, active) >= 0.9


def test_recall_on_clusters_while_few_codes_are_compared_exactly(spark):
    _, exits = clustered(spark, 200, 40, 1, 0.1, 16)
    _, active = clustered(spark, 8000, 40, 2, 0.1, 16, first=1000)
    assert recall(exits.where("id > 5"), active) >= 0.9
    unit = lambda df: df.where("embedding IS NOT NULL").selectExpr("id", "embedding AS v")
    index = inverted.learned(unit(active), unit(exits), 8000, 3, 0.97, None, 11)
    assert index.probes < len(index.centres) / 2
    lists = index.cells(inverted.units(r.v for r in unit(active).collect()))
    sizes = np.bincount(lists, minlength=len(index.centres))
    asked = inverted.units(r.v for r in unit(exits).collect())
    scanned = sizes[np.argsort(-(asked @ index.centres.T), axis=1)[:, : index.probes]].sum()
    assert inverted.estimated(unit(exits), unit(active), index, 12).count() <= 0.1 * scanned


def test_a_cell_cut_into_blocks_gives_the_same_rows(spark):
    _, exits = clustered(spark, 50, 3, 1)
    _, active = clustered(spark, 300, 3, 2, first=1000)
    unit = lambda df: df.where("embedding IS NOT NULL").selectExpr("id", "embedding AS v")
    index = inverted.learned(unit(active), unit(exits), 300, 3, 0.97, 4, 11)
    pairs = lambda size: {tuple(r) for r in inverted.estimated(unit(exits), unit(active), index, 7, size).collect()}
    assert pairs(5) == pairs(2048)


def test_codes_are_near_their_vectors():
    rng = np.random.default_rng(3)
    u = inverted.units(rng.normal(size=(50, 8)))
    index = inverted.Index(u[:3], np.full(8, -2.0), np.full(8, 4 / 255), 1)
    cells = index.cells(u)
    back = np.stack([index.decoded(c, k) for c, k in zip(index.codes(u, cells), cells)])
    assert np.abs(back - u).max() <= 2 / 255 + 1e-9


def test_copies_of_one_vector(spark):
    rows = spark.createDataFrame([(i, 0, [1.0, 0.0] if i else [0.0, 1.0]) for i in range(300)], "id long, identity long, embedding array<double>")
    got = {tuple(r) for r in inverted.ivf_topk(rows.where("id < 3"), rows, k=2).collect()}
    assert got >= {(1, 1, 1, 1.0), (1, 2, 2, 1.0), (2, 1, 1, 1.0), (2, 2, 2, 1.0), (0, 1, 0, 1.0)}


def test_empty_and_null_sides(spark):
    empty = spark.createDataFrame([], "id long, identity long, embedding array<double>")
    one = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, None)], empty.schema)
    assert inverted.ivf_topk(empty, empty).count() == 0 and inverted.ivf_topk(one, empty).count() == 0 and inverted.ivf_topk(empty, one).count() == 0
    assert [tuple(r) for r in inverted.ivf_topk(one, one).collect()] == [(1, 1, 1, 1.0)]


def test_a_query_goes_to_a_shelf_of_cells_once(spark, monkeypatch):
    """Vectors without clusters, all cells probed: one copy of a query for all cells, not one for each."""
    rng = np.random.default_rng(5)
    rows = lambda n, first: spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 8)))], "id long, v array<double>")
    asked, gallery = rows(30, 0), rows(400, 1000)
    index = inverted.learned(gallery, asked, 400, 3, 0.97, 20, 11)
    entries = sorted((r.id, inverted.units([r.v])[0]) for r in gallery.collect())
    u = np.stack([v for _, v in entries])
    home = index.cells(u)
    back = np.stack([index.decoded(c, k) for c, k in zip(index.codes(u, home), home)])
    want = set()
    for r in asked.collect():
        sims = np.round(back @ inverted.units([r.v])[0], 9)
        want |= {(r.id, entries[j][0]) for j in sorted(range(400), key=lambda j: (-sims[j], entries[j][0]))[:6]}
    for size in ({}, {"size": 64}):
        assert {tuple(r) for r in inverted.estimated(asked, gallery, index, 6, **size).collect()} == want
    seen = []
    monkeypatch.setattr(inverted, "written", lambda df, at: seen.append(written(df, at)) or seen[-1])
    inverted.estimated(asked, gallery, index, 6).count()
    copies = seen[1].selectExpr("explode(shelf)").count() if "shelf" in seen[1].columns else seen[1].count()
    assert copies == 30 and len(index.centres) == 20
