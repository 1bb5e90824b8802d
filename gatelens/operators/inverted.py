"""Approximate search by an inverted list with quantised residuals.

Gallery rows go to the nearest of about sqrt(rows) cells (at most CELLS). A row's list entry is its id and one byte a dimension: what is left of its unit vector
behind the cell's centre, in steps learned for each dimension. Cells near each other share a shelf. A query scans the codes of its nearest cells, in blocks of a shelf, so that a
cell with a third of all rows is many tasks; the best ``depth`` of its estimates are compared exactly, and only these meet the full vectors.

Learned on bounded samples of the gallery and of the queries: centres and steps, and how many cells to probe, the number that holds the wanted part of the true
neighbours within the sample. Every row is indexed, every query answered. Rows with null vectors take no part; ties go to the smaller id; an empty side gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import folder, written

#: Most cells: their centres go with every task.
CELLS = 4096
#: Gallery rows that centres, steps and probes are learned from, on the driver, and queries for the latter.
SAMPLE, ASKED = 20_000, 200
#: Queries and codes whose estimates are held at once; the fewest queries of a block, about.
SIDE = 2048


@dataclass(frozen=True)
class Index:
    centres: np.ndarray
    low: np.ndarray
    step: np.ndarray
    probes: int

    def cells(self, units: np.ndarray) -> np.ndarray:
        return nearest(units, self.centres)

    def codes(self, units: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((units - self.centres[cells] - self.low) / self.step), 0, 255).astype(np.uint8)

    def decoded(self, codes: np.ndarray, cell: int) -> np.ndarray:
        return self.centres[cell] + self.low + codes * self.step


def units(vectors) -> np.ndarray:
    m = np.stack(list(vectors)).astype(float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(rows[i : i + 2000] @ centres.T).argmax(axis=1) for i in range(0, len(rows), 2000)])


def middles(rows: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centres of up to ``cells`` groups of unit vectors by angle: from different rows, each moved to the mean of its rows; one without rows stays."""
    centres = np.unique(rows, axis=0)
    centres = centres[np.random.default_rng(0).permutation(len(centres))[:cells]]
    for _ in range(rounds):
        home = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def learned(gallery: DataFrame, asked: DataFrame, n: int, k: int, recall: float, probes: int | None, seed: int) -> Index:
    """Centres, steps and probes from about SAMPLE rows and ASKED queries, which come to the driver."""
    part = gallery if n <= SAMPLE else gallery.sample(SAMPLE / n, seed)
    rows = part.select("v").limit(2 * SAMPLE).collect() or gallery.select("v").limit(1).collect()
    seen = units(r.v for r in rows)
    centres = middles(seen, min(CELLS, max(1, round(sqrt(n)))))
    home = nearest(seen, centres)
    left = seen - centres[home]
    low, high = left.min(axis=0), left.max(axis=0)
    if probes is None:
        queries = asked.orderBy(F.xxhash64("id"), "id").limit(ASKED).collect()
        q = units(r.v for r in queries) if queries else seen[:1]
        order = np.argsort(-(q @ centres.T), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(q), 0), axis=1)
        true = np.argsort(-(q @ seen.T), axis=1)[:, :k]
        probes = int(np.quantile(np.take_along_axis(place, home[true], axis=1), recall, method="higher")) + 1
    return Index(centres, low, np.maximum((high - low) / 255, 1e-12), min(probes, len(centres)))


def best(asks: np.ndarray, who: np.ndarray, what: np.ndarray, ids: np.ndarray, cells: np.ndarray, codes: np.ndarray, index: Index, depth: int, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """The estimates and ids of each query's ``depth`` best, ties by smaller id, over the codes of its cells; query who[i] probes cell what[i]. Ids are ascending; places without a row
    have an estimate of minus infinity. At most ``side`` queries and codes meet at once."""
    sims, found = np.full((len(asks), depth), -np.inf), np.full((len(asks), depth), np.iinfo(np.int64).max)
    who, what = who[o := np.argsort(what, kind="stable")], what[o]
    by_cell = np.argsort(cells, kind="stable")
    for cell in np.unique(cells):
        mine = by_cell[slice(*np.searchsorted(cells[by_cell], [cell, cell + 1]))]
        asking = who[slice(*np.searchsorted(what, [cell, cell + 1]))]
        for j in range(0, len(mine) if len(asking) else 0, side):
            at = mine[j : j + side]
            columns = index.decoded(codes[at], int(cell)).T
            for i in range(0, len(asking), side):
                rows = asking[i : i + side]
                near = np.rint(asks[rows] @ columns * 1e9)
                key = near.astype(np.int64) * len(at) - np.arange(len(at))  # of equal estimates the smaller ids, however many there are
                top = np.argpartition(-key, depth - 1, axis=1)[:, :depth] if len(at) > depth else np.broadcast_to(np.arange(len(at)), key.shape)
                s = np.concatenate([sims[rows], np.take_along_axis(near, top, axis=1) / 1e9], axis=1)
                n = np.concatenate([found[rows], ids[at][top]], axis=1)
                o = np.lexsort((n, -s), axis=1)[:, :depth]
                sims[rows], found[rows] = np.take_along_axis(s, o, axis=1), np.take_along_axis(n, o, axis=1)
    return sims, found


def estimated(asked: DataFrame, gallery: DataFrame, index: Index, depth: int, size: int | None = None) -> DataFrame:
    """a, b: for each query the ``depth`` gallery rows with the best estimates over the codes of its cells. Cells near each other share a shelf of about ``size`` codes (an eighth of
    all, within bounds), and a query
    goes to a shelf once, however many of its cells it probes, and brings back ``depth`` rows from there; a shelf with more codes or queries is cut into blocks."""
    spark = gallery.sparkSession
    n, m = gallery.count(), asked.count()
    columns, rows = size or min(max(n // 8, 16_384), 65_536), size or min(max(m // 8, SIDE), 16_384)  # so that blocks grow before their number does
    shelf = nearest(index.centres, middles(index.centres, -(-n // columns))) if n > columns else np.zeros(len(index.centres), int)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                u = units(rows["v"])
                cell = index.cells(u)
                yield pd.DataFrame({"id": rows["id"], "k": cell, "shelf": shelf[cell], "code": [c.tobytes() for c in index.codes(u, cell)]})

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                u = units(rows["v"])
                ks = np.argsort(-(u @ index.centres.T), axis=1, kind="stable")[:, : index.probes]
                shelves = [np.unique(shelf[k]) for k in ks]
                yield pd.DataFrame({"id": rows["id"], "v": list(u), "shelf": shelves, "ks": [[k[shelf[k] == at].astype(np.uint16).tobytes() for at in of] for k, of in zip(ks, shelves)]})

    def scan(rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(entries):
            return pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": "int64", "b": "int64", "sim": "float64"})
        entries = entries.sort_values("id")
        codes = np.frombuffer(b"".join(entries["code"]), np.uint8).reshape(len(entries), -1)
        probed = [np.frombuffer(k, np.uint16) for k in rows["ks"]]
        who = np.repeat(np.arange(len(rows)), [len(k) for k in probed])
        sims, found = best(np.stack(rows["v"].to_numpy()), who, np.concatenate(probed).astype(int), entries["id"].to_numpy(), entries["k"].to_numpy(), codes, index, depth)
        full = np.isfinite(sims)
        return pd.DataFrame({"a": rows["id"].to_numpy().repeat(full.sum(axis=1)), "b": found[full], "sim": sims[full]})

    entries = written(gallery.mapInPandas(listed, "id long, k int, shelf int, code binary"), f"{folder(spark, 'lists')}/entries")
    queries = written(asked.mapInPandas(routed, "id long, v array<double>, shelf array<int>, ks array<binary>"), f"{folder(spark, 'lists')}/queries")
    count = lambda df, name, most: df.groupBy("shelf").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    plan = F.broadcast(count(queries.select(F.explode("shelf").alias("shelf")), "rows", rows).join(count(entries, "columns", columns), "shelf"))  # at most CELLS rows
    deal = lambda over: F.pmod(F.xxhash64("id"), F.col(over)).cast("int")
    every = lambda over: F.explode(F.sequence(F.lit(0), F.col(over) - 1))
    each = queries.select("id", "v", F.explode(F.arrays_zip("shelf", "ks")).alias("p")).select("id", "v", "p.shelf", "p.ks")
    a = each.join(plan, "shelf").withColumn("i", deal("rows")).select("shelf", "i", every("columns").alias("j"), "id", "v", "ks")
    b = entries.join(plan, "shelf").withColumn("j", deal("columns")).select("shelf", every("rows").alias("i"), "j", "id", "k", "code")
    found = a.groupBy("shelf", "i", "j").cogroup(b.groupBy("shelf", "i", "j")).applyInPandas(scan, "a long, b long, sim double")
    order = W.partitionBy("a").orderBy(F.desc("sim"), "b")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= depth).select("a", "b")


def ivf_topk(exits: DataFrame, active: DataFrame, k: int = 3, depth: int | None = None, recall: float = 0.97, probes: int | None = None, seed: int = 11) -> DataFrame:
    """id, rank, active_id, sim: the ``k`` most alike among the ``depth`` (4 * k) best estimates of each query. ``recall``: part of the true neighbours within
    the samples whose cells are probed, or ``probes`` cells."""
    unit = lambda df: df.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    gallery, asked = unit(active), unit(exits)
    n = gallery.count()
    if not n:
        return asked.select("id", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("active_id"), F.lit(0.0).alias("sim")).where("false")
    pairs = estimated(asked, gallery, learned(gallery, asked, n, k, recall, probes, seed), depth or 4 * k)
    both = pairs.join(gallery.select(F.col("id").alias("b"), F.col("v").alias("y")), "b").join(asked.select(F.col("id").alias("a"), F.col("v").alias("x")), "a")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    sim = F.round(dot("x", "y") / F.greatest(F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y")), F.lit(1e-12)), 6)
    exact = both.select("a", "b", sim.alias("sim")).distinct()
    order = W.partitionBy("a").orderBy(F.desc("sim"), "b")
    rows = exact.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return rows.select(F.col("a").alias("id"), "rank", F.col("b").alias("active_id"), "sim")
