"""An exact metric index: rows go only where an answer can be.

Rows of both sides go to the nearest of up to CENTRES centres, drawn from the gallery; a cluster is known by its centre and its largest angle. Angles keep the
triangle inequality, so no row of one cluster is nearer to a row of another than the angle between the centres less both largest angles. Where
a threshold is asked for, pairs of clusters beyond it are dropped. Where the best k are asked for, a first pass compares every row with
gallery rows near it; the k-th best found there is as far as it has to look, and the least of these bounds within a cluster tells
which other clusters it must meet. Clusters that lie together form a region, large regions are cut into blocks, and a cluster's rows go to the blocks of
those regions that hold a cluster they must meet. Where the vectors have no clusters nothing can be dropped; then the plain blocks of
``search.matched`` are cheaper and are taken.

The driver holds at most CENTRES vectors and one bit for each pair of them. Vectors of length 0 have no angle: they are a cluster of their own that
meets all. Rows with null vectors take no part."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import folder, written

#: Most clusters, and gallery rows for each where there are fewer.
CENTRES, ROWS_EACH = 2048, 32
#: Share of the rows, those with the farthest k-th best or the largest angle, that are kept apart.
APART = 0.1
#: Similarities are told in six decimals; doubles err far less.
SLACK = 1e-6


def centres_of(gallery: DataFrame, n: int) -> np.ndarray:
    """Unit vectors of the rows that come first by the hash of their id, one for each ROWS_EACH rows."""
    most = min(CENTRES, max(1, math.ceil(n / ROWS_EACH)))
    drawn = gallery.where(F.exists("v", lambda x: x != 0)).select("v", F.xxhash64("id").alias("h")).orderBy("h", "v").limit(most)
    m = np.array([r.v for r in drawn.collect()], float)
    return m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else np.zeros((0, 0))


def placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, v (of length 1, or 0), cluster (the number of centres for vectors of length 0), angle to the centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            m = np.stack(batch["v"].to_numpy())
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(norm > 0, norm, 1)
            near = m @ centres.T if len(centres) else np.zeros((len(m), 1))
            cluster = np.where(norm[:, 0] > 0, near.argmax(axis=1), len(centres))
            # the chord gives small angles exactly, where the cosine does not
            chord = np.linalg.norm(m - centres[np.minimum(cluster, len(centres) - 1)], axis=1) if len(centres) else np.zeros(len(m))
            angle = np.where(norm[:, 0] > 0, 2 * np.arcsin(np.minimum(chord / 2, 1)), math.pi)
            yield pd.DataFrame({"id": batch["id"], "v": list(m), "cluster": cluster.astype(np.int32), "angle": angle})

    return rows.mapInPandas(run, "id long, v array<double>, cluster int, angle double")


def regions(centres: np.ndarray, n: int) -> np.ndarray:
    """The region of each cluster, by the nearest of the first n centres; the cluster without angle is in the first."""
    return np.r_[(centres @ centres[: max(1, n)].T).argmax(axis=1) if len(centres) else np.zeros(0, int), 0]


def meetings(centres: np.ndarray, asked: pd.DataFrame, gallery: pd.DataFrame) -> np.ndarray:
    """Which units of the asking side (cluster, angle, bound) must meet which of the gallery (cluster, angle)."""
    n = len(centres)
    if not n:
        return np.ones((len(asked), len(gallery)), bool)
    c, d = (side["cluster"].to_numpy() for side in (asked, gallery))
    between = np.arccos(np.clip(centres[np.minimum(c, n - 1)] @ centres[np.minimum(d, n - 1)].T, -1, 1))
    least = between - asked["angle"].to_numpy()[:, None] - gallery["angle"].to_numpy()[None, :]
    # a cosine near 1 tells an angle to 1e-7 only, far less than the slack in similarity there
    best = np.cos(np.clip(least - 1e-7, 0, math.pi))
    return (c == n)[:, None] | (d == n)[None, :] | (best >= asked["bound"].to_numpy()[:, None] - SLACK)


def routes(left: DataFrame, right: DataFrame, keep, k: int | None, least: float, size: int) -> tuple[DataFrame, DataFrame] | None:
    """Both sides as id, v and the blocks where they meet (c, i, d, j); None where that is no cheaper than all pairs of blocks.

    keep: as in ``search.matched``, for the first pass where the best ``k`` are asked for; else ``least`` is the threshold of all."""
    from .search import matched

    spark, at = left.sparkSession, folder(left.sparkSession, "angles")
    vec = lambda df: df.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    left, right = vec(left), vec(right)
    n_right = right.count()
    centres = centres_of(right, n_right)
    region = regions(centres, min(len(centres), math.ceil(n_right / size)))
    def facts_of(rows: DataFrame) -> pd.DataFrame:
        facts = rows.groupBy("unit", "cluster", "apart").agg(F.count("*").alias("n"), F.max("angle").alias("angle"), F.min("bound").alias("bound")).collect()  # at most two rows a cluster
        facts = pd.DataFrame([r.asDict() for r in facts], columns=["unit", "cluster", "apart", "n", "angle", "bound"]).sort_values("unit", ignore_index=True)
        facts["region"] = np.where(facts["apart"].astype(bool), len(centres), region[facts["cluster"].to_numpy(int)])
        facts["blocks"] = np.ceil(facts.groupby("region")["n"].transform("sum") / size).astype(int)
        return facts

    whole = [F.col("cluster").alias("unit"), F.lit(False).alias("apart"), F.lit(float(least)).alias("bound")]
    def set_apart(rows: DataFrame, apart: Column) -> DataFrame:
        """Rows that would widen what their cluster must meet are units of their own, in a region apart."""
        return rows.withColumn("apart", apart).withColumn("unit", F.col("cluster") + F.when(F.col("apart"), len(centres) + 1).otherwise(0))

    wide = lambda rows: F.col("angle") > (rows.agg(F.percentile_approx("angle", 1 - APART)).first()[0] or 0.0)
    a, b = (written(placed(side, centres), f"{at}/{name}").select("*", *whole) for side, name in ((left, "asked"), (right, "gallery")))
    a, b = set_apart(a, wide(a)), set_apart(b, wide(b))
    asked, gallery = facts_of(a), facts_of(b)
    if not len(asked) or not len(gallery):
        return None
    if k:
        def first(rows: DataFrame, facts: pd.DataFrame) -> DataFrame:
            of = spark.createDataFrame(facts[["unit", "region", "blocks"]].astype(int))
            return rows.join(F.broadcast(of), "unit").select("id", F.col("v").alias("embedding"), "region", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))

        seen = matched(first(a, asked), first(b, gallery).where("block = 0"), keep, "region", size)  # a bound needs no more than some rows
        order = W.partitionBy("a").orderBy(F.desc("sim"))
        kth = seen.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select(F.col("a").alias("id"), F.col("sim").alias("kth"))
        # what does not reach the threshold is of no use, so nobody looks beyond it
        bounded = written(a.drop("bound", "unit", "apart").join(kth, "id", "left").withColumn("bound", F.greatest(F.coalesce("kth", F.lit(-2.0)), F.lit(least))).drop("kth"), f"{at}/bounded")
        # rows with few others near them look far
        far = F.col("bound") <= (bounded.agg(F.percentile_approx("bound", APART)).first()[0] or 0.0)
        a = set_apart(bounded, far | wide(bounded))
        asked = facts_of(a)
    must = meetings(centres, asked, gallery)
    blocks_of = [facts.drop_duplicates("region").set_index("region")["blocks"].to_dict() for facts in (asked, gallery)]

    def sent(facts: pd.DataFrame, others: pd.DataFrame, must: np.ndarray, there: dict) -> list[tuple]:
        """unit, region, blocks, and the regions with their blocks where its rows go."""
        places = others["region"].to_numpy()
        to = [[(int(r), int(there[r])) for r in np.unique(places[row])] for row in must]
        return [(int(c), int(r), int(n), t) for c, r, n, t in zip(facts["unit"], facts["region"], facts["blocks"], to)]

    plans = sent(asked, gallery, must, blocks_of[1]), sent(gallery, asked, must.T, blocks_of[0])
    cost = sum(int(n) * sum(blocks for _, blocks in p[3]) for facts, plan in zip((asked, gallery), plans) for n, p in zip(facts["n"], plan))
    n_a, n_b = int(asked["n"].sum()), int(gallery["n"].sum())
    if cost >= n_a * math.ceil(n_b / size) + n_b * math.ceil(n_a / size):
        return None

    def dealt(rows: DataFrame, plan: list[tuple], own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        routes = spark.createDataFrame(plan, "unit int, region int, blocks int, to array<struct<region: int, blocks: int>>")
        here = rows.join(F.broadcast(routes), "unit").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        here = here.select("id", "v", F.col("region").alias(own[0]), F.col("block").alias(own[1]), F.explode("to").alias("t"))
        return here.select("id", "v", *own, F.col("t.region").alias(other[0]), F.explode(F.sequence(F.lit(0), F.col("t.blocks") - 1)).alias(other[1]))

    return dealt(a, plans[0], ("c", "i"), ("d", "j")), dealt(b, plans[1], ("d", "j"), ("c", "i"))
