import random

import pytest

from gatelens.operators.admission import admission, occupied, stretches

SCHEMA = "event_id long, lot long, plate string, ts timestamp_ntz, kind string"


def plain(rows, capacity):
    """Event by event, each lot with the plates that are in."""
    inside, codes = {}, set()
    for event, lot, plate, ts, kind in sorted((r for r in rows if r[1] is not None and r[3] is not None), key=lambda r: (r[3], r[0])):
        held = inside.setdefault(lot, set())
        if kind == "exit":
            held.discard(plate)
            continue
        code = -1 if len(held) >= capacity else -2 if plate in held else event
        if code == event:
            held.add(plate)
        codes.add((event, lot, code))
    return codes


def made(n, lots, plates, seed, share=0.5):
    """Events with ties in time, plates that come twice and exits of plates that are out; the demand rises and falls."""
    import datetime as dt

    rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        busy = share + (0.3 if (i // 100) % 2 else -0.3)
        plate = None if rng.random() < 0.01 else f"P{rng.randrange(plates)}"
        rows.append((i, rng.randrange(lots), plate, start + dt.timedelta(seconds=i // 2), "entry" if rng.random() < busy else "exit"))
    return rows


def found(spark, rows, capacity, **cut):
    return {tuple(r) for r in admission(spark.createDataFrame(rows, SCHEMA), capacity, **cut).collect()}


@pytest.mark.parametrize("capacity, plates, share", [(3, 12, 0.5), (10, 40, 0.5), (10, 15, 0.7), (1, 5, 0.4), (0, 5, 0.5), (500, 50, 0.6)])
def test_codes_equal_a_plain_walk(spark, capacity, plates, share):
    rows = made(1500, 3, plates, capacity, share) + [(9001, None, "P1", None, "entry"), (9002, 0, "P1", None, "entry"), (9003, None, "P1", made(1, 1, 1, 0)[0][3], "entry")]
    assert found(spark, rows, capacity) == plain(rows, capacity)


@pytest.mark.parametrize("seed", [1, 2])
def test_lot_cut_into_ranges_of_time(spark, seed):
    rows = made(3000, 1, 60, seed)
    assert found(spark, rows, 20, share=1e-6, least_rows=1) == plain(rows, 20)


def test_one_lot_has_many_stretches_and_the_rest_is_a_formula(spark):
    rows = made(4000, 1, 40, 5)
    counts = stretches(*occupied(spark.createDataFrame(rows, SCHEMA), 30)[:2], 30).groupBy("stretch").count().collect()
    sizes = {r.stretch: r["count"] for r in counts}
    assert len(sizes) > 10 and sizes[None] > 1000 and max(n for s, n in sizes.items() if s is not None) < 1000


def test_no_events(spark):
    assert found(spark, [], 5) == set()


def test_registered_query_equals_its_sql_where_a_lot_holds_more_than_500(spark):
    import duckdb

    from gatelens.plans.queries import ORACLE_SQL, SPECS

    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, 5 * (i % 700) AS user_id, TIMESTAMP '2024-01-01' + to_minutes(i::INT) AS ts, CASE WHEN i % 9 = 8 THEN 'click' ELSE 'view' END AS event_type FROM range(1500) r(i)")
    rows = [(e, u % 5, f"P{u}", t, "exit" if k == "click" else "entry") for e, u, t, k in con.execute("SELECT event_id, user_id, ts, event_type FROM events").fetchall()]
    want = {tuple(r) for r in con.execute(ORACLE_SQL["admission"]).fetchall()}
    assert {(r.event_id, r.lot, r.code) for r in SPECS["admission"][0](spark.createDataFrame(rows, SCHEMA)).collect()} == want
    assert any(code == -1 for _, _, code in found(spark, rows, 500))
