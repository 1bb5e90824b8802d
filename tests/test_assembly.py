import duckdb
import pytest

from gatelens.plans.queries import ORACLE_SQL, SPECS
from gatelens.sources.views import VIEWS


@pytest.mark.parametrize("name, crops", [("assemble_reads", 300)])
def test_crops_at_equal_distances_fall_as_in_sql(spark, name, crops):
    """Small whole places make characters at equal distances from the line; partitions of a row each must not decide on their side."""
    con = duckdb.connect()
    con.execute(f"""CREATE TABLE lineitem AS SELECT i // 6 AS l_orderkey, hash(i) % 7 * 10 AS l_partkey, hash(i + 7) % 4 AS l_suppkey, (i % 6 + 1)::INT AS l_linenumber, 1.0::DOUBLE AS l_quantity,
     (hash(i * 3) % 90000 / 100)::DOUBLE AS l_extendedprice FROM range({6 * crops}) r(i)""")
    con.execute("UPDATE lineitem SET l_partkey = l_partkey::BIGINT, l_suppkey = l_suppkey::BIGINT")
    want = sorted(con.execute(ORACLE_SQL[name]).fetchall())
    given = con.execute("SELECT l_orderkey::BIGINT, l_partkey::BIGINT, l_suppkey::BIGINT, l_linenumber, l_extendedprice FROM lineitem ORDER BY hash(l_orderkey * 7 + l_linenumber)").fetchall()
    rows = spark.createDataFrame(given, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double").repartition(16)
    chars = spark.sql(VIEWS["v_chars"], lineitem=rows).repartition(16)
    got = sorted((r.crop_id, r.text, r.conf, r.n_rows) for r in SPECS[name][0](chars).select("crop_id", "text", "conf", "n_rows").collect())
    assert len(got) == len(want) == crops and [w for w, g in zip(want, got) if w != g] == []


def test_order_of_rows_decides_nothing(spark):
    import random

    rng = random.Random(4)
    rows = [(crop, i, "ABCDEFG"[rng.randrange(7)], rng.randrange(7) * 10.0, rng.randrange(4) + 40.0 * (i % 2), 24.0, 0.5) for crop in range(10000) for i in range(6)]
    read = lambda given: sorted(map(tuple, SPECS["assemble_reads_midrange"][0](spark.createDataFrame(given, "crop_id long, char_id long, ch string, cx double, cy double, h double, conf double").coalesce(1)).collect()))
    assert [p for p in zip(read(rows), read(rows[::-1])) if p[0] != p[1]] == []


def test_midrange_crops_at_the_middle_fall_as_in_sql(spark):
    """Crops with a character in the very middle of the distances: the last digit of the line decides on its side."""
    crops = [[(87, 45), (67, 43), (219, 6), (55, 4)], [(121, 46), (164, 45), (41, 4), (207, 44), (143, 44)], [(270, 1), (145, 41), (244, 0), (164, 2), (196, 45)]]
    given = []
    for crop, chars in enumerate(crops):
        line = 0
        for x, y in chars:  # odd lines are 40 lower
            line += 1 if line % 2 != (y >= 40) else 2
            given.append((crop, x, y % 40, line, 1.0, 10.0 + line))
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?, ?, ?)", given)
    want = sorted(con.execute(ORACLE_SQL["assemble_reads_midrange"]).fetchall())
    rows = spark.createDataFrame(given, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double")
    got = SPECS["assemble_reads_midrange"][0](spark.sql(VIEWS["v_chars"], lineitem=rows))
    assert sorted(map(tuple, got.select("crop_id", "text", "conf", "n_rows").collect())) == want
