"""Exact percentiles of large groups: the ranges that hold the wanted ranks are narrowed by histograms of bounded size.

A round counts the values of each range in BINS equal bins, with the least and largest value of each; the bin that holds a rank becomes its range.
A range is done when its ends are equal. So a round is a scan and an aggregate of at most BINS rows a range, whatever the group's size, and
the number of rounds grows with the digits of a double at most. No buffer holds a group's values. Nulls, NaN and infinite values are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import folder, written

BINS, MOST_ROUNDS = 1024, 200


def exact_percentiles(rows: DataFrame, key: Column, value: Column, shares: list[float], bins: int = BINS) -> DataFrame:
    """key, n, cuts: for each share the value at place share * (n - 1) of the sorted values, interpolated between neighbours; a group without values has no row."""
    at = folder(rows.sparkSession, "percentiles")
    held = rows.select(key.alias("key"), value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')")
    facts = written(held.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), f"{at}/groups")
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)) + 1, F.ceil(place(p)) + 1) for p in shares])))
    targets = written(facts.select("key", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below")), f"{at}/targets-0")
    for turn in range(1, MOST_ROUNDS):
        wide = targets.where("lo < hi")
        if wide.isEmpty():
            break
        ranges = wide.select("key", "lo", "hi").distinct()
        inside = held.join(ranges.withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of"))).where("v BETWEEN lo AND hi")
        # halves first: the difference of two doubles may be too large for one
        bin_of = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        counted = inside.groupBy("key", "lo", "hi", bin_of.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        summed = counted.withColumn("to", F.sum("c").over(W.partitionBy("key", "lo", "hi").orderBy("bin")))
        same = F.col("t.key").eqNullSafe(F.col("s.key")) & (F.col("t.lo") == F.col("s.lo")) & (F.col("t.hi") == F.col("s.hi"))
        has = (F.col("rank") > F.col("below") + F.col("to") - F.col("c")) & (F.col("rank") <= F.col("below") + F.col("to"))
        narrow = wide.alias("t").join(summed.alias("s"), same & has).select("t.key", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("to") - F.col("c")).alias("below"))
        targets = written(targets.where("lo >= hi").unionByName(narrow), f"{at}/targets-{turn}")
    else:
        raise RuntimeError(f"ranges did not settle in {MOST_ROUNDS} rounds")
    found = targets.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.col("lo").alias("v")))).alias("at_rank"))  # two entries a share at most
    rows = facts.alias("f").join(found.withColumnRenamed("key", "of"), F.col("f.key").eqNullSafe(F.col("of")))

    def cut(p: float) -> Column:
        low, high = (F.element_at("at_rank", side(place(p)) + 1) for side in (F.floor, F.ceil))
        part = place(p) - F.floor(place(p))
        return low * (1 - part) + high * part

    return rows.select("f.key", "n", F.array(*map(cut, shares)).alias("cuts"))

