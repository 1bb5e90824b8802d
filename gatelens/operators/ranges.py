"""Windows over keys with very many rows, without a task that reads a whole key.

The rows of a key that holds more than ``share`` of all rows are cut at quantiles of their time into ranges of about equal size; every other key is one
range. There are fewer than 1 / share such keys and at most RANGES ranges of each, so what is known of ranges is a small table whatever the size of
the data. A window runs within a range; what it needs from the ranges before comes as a carry (a sum, a last value, folded for each range and
scanned once) or as a halo (the last rows before the range, repeated in it and dropped behind the window).

Rows with equal times stay in one range. Null times come first, in the first range. Null keys are a key like any other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of a key with many rows.
RANGES = 64
#: Part of all rows from which on a key is cut.
SHARE = 0.001
#: Tables with fewer rows are one range a key: there is nothing to spread.
LEAST_ROWS = 200_000


class Ranges:
    """The rows with a column ``part``, and what is known of their ranges."""

    def __init__(self, rows: DataFrame, key: str, time: str, share: float | None = None, least_rows: int | None = None):
        self.key, self.time = key, time
        share, least_rows = share or SHARE, LEAST_ROWS if least_rows is None else least_rows
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({time} AS TIMESTAMP_NTZ))")
        at = micros if rows.schema[time].dataType.typeName().startswith("timestamp") else F.col(time).cast("long")
        counts = rows.groupBy(key).agg(F.count("*").alias("n"))
        all_n = counts.agg(F.sum("n")).first()[0] or 0
        many = counts.where((F.col("n") > share * all_n) & F.col(key).isNotNull()).select(key) if all_n >= least_rows else None
        self.cut = None
        if many is not None:
            steps = [i / RANGES for i in range(1, RANGES)]
            cuts = rows.join(F.broadcast(many), key).groupBy(key).agg(F.percentile_approx(at, steps, 2000).alias("cuts"))
            found = cuts.collect()  # fewer than 1 / share rows of RANGES numbers; fixed here, so that every reader sees the same cuts
            if found:
                self.cut = rows.sparkSession.createDataFrame(found, cuts.schema)
        if self.cut is None:
            self.rows = rows.withColumn("part", F.lit(0))
        else:
            below = F.coalesce(F.size(F.filter("cuts", lambda c: c < at)), F.lit(0))
            self.rows = rows.join(F.broadcast(self.cut), key, "left").withColumn("part", F.when(F.col("cuts").isNotNull(), below).otherwise(0)).drop("cuts")

    def window(self, *order: Column | str):
        return W.partitionBy(self.key, "part").orderBy(*order)

    def _known(self) -> DataFrame:
        """Rows of the keys that are cut."""
        return self.rows.join(F.broadcast(self.cut.select(self.key)), self.key, "left_semi")

    def carried(self, rows: DataFrame, name: str, fold: Column, scan: Callable[[Column], Column]) -> DataFrame:
        """``rows`` with ``name``: ``scan`` over the ``fold`` of each earlier range; null where there is none."""
        if self.cut is None:
            return rows.withColumn(name, F.lit(None).cast("long"))
        folds = self._known().groupBy(self.key, "part").agg(fold.alias("fold"))
        before = W.partitionBy(self.key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        carry = folds.select(self.key, "part", scan(F.col("fold")).over(before).alias(name))
        return rows.join(F.broadcast(carry), [self.key, "part"], "left")

    def with_halo(self, width: int, *order: str) -> DataFrame:
        """The rows, and with ``halo`` true the last ``width`` ones before each range once more, in that range."""
        own = self.rows.withColumn("halo", F.lit(False))
        if self.cut is None or width < 1:
            return own
        names = self.rows.columns
        falling = W.partitionBy(self.key, "part").orderBy(*[F.desc(c) for c in order])
        last = self._known().withColumn("back", F.row_number().over(falling)).where(F.col("back") <= width)
        tails = last.groupBy(self.key, "part").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[c for c in names if c not in (self.key, "part")]).alias("row")))).alias("tail"))
        every = self.cut.select(self.key, F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1))).alias("part"))
        before = W.partitionBy(self.key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        held = every.join(F.broadcast(tails), [self.key, "part"], "left").withColumn("held", F.flatten(F.collect_list("tail").over(before)))
        held = held.select(self.key, "part", F.explode(F.expr(f"slice(held, greatest(1, size(held) - {width - 1}), {width})")).alias("h"))
        halo = held.select(self.key, "part", "h.row.*").select(*names).withColumn("halo", F.lit(True))
        return own.unionByName(halo)
