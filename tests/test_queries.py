import pytest

from gatelens.operators import boxes, gates
from gatelens.plans.queries import ORACLE_SQL

from .oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, name):
    compare(spark, name)


def test_vote_tie_goes_to_the_oldest(spark):
    reads = spark.createDataFrame([(i, 1, i, v) for i, v in enumerate(["B", "", "A", "A", "B"])], "event_id int, lane int, ts int, raw string")
    found = {r.event_id: r.stable for r in gates.plate_vote(reads).collect()}
    assert found == {0: None, 2: None, 3: "A", 4: "B"}


def test_second_entry_is_a_duplicate_and_exit_needs_an_entry(spark):
    rows = [(1, 0, "P", 1, "exit"), (2, 0, "P", 2, "entry"), (3, 0, "P", 3, "entry"), (4, 0, "P", 4, "exit")]
    events = spark.createDataFrame(rows, "event_id int, lot int, plate string, ts int, kind string")
    assert [r.event_id for r in gates.accepted(events).orderBy("ts").collect()] == [2, 4]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "frame_id int, det_id int, x1 int, y1 int, x2 int, y2 int, conf double")
    assert boxes.best_box(empty).count() == 0 and boxes.box_clamp(empty).count() == 0
