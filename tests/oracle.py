"""Runs a query and its SQL over the same tables and compares rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(records, columns):
    return sorted(repr([r[c] for c in columns]) for r in records)


def compare(spark, name, sf_dir="/root/testdata/sf0.001"):
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf_dir)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    expected = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert rows_of([r.asDict(recursive=True) for r in got.collect()], columns) == rows_of(expected, columns)
