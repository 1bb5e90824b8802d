"""Hard negatives: rows of other labels whose score with an anchor lies in a window below the score of one of its positives.

Rows are put in the order of a Hilbert curve within their label and packed into Parquet blocks, a block a row of the file, with the least and largest value of
every dimension (its zone map) in columns of their own. Scores are inner products of whole numbers, so interval arithmetic over a zone map gives
exact bounds of all scores between a block and an anchor; a block is read for a group of anchors only where some anchor's window overlaps
these bounds. Anchors are packed along the same curve. A first pass over the nearest blocks of each group finds scores that the
second need not go below. What is read goes to tiles of one group and some of its blocks, nearest first: a task holds one group and one
block at a time, skips blocks that cannot better what it has, and hands on at most k rows for each window.

Rows with a null label or vector, or any null or non-finite component, take no part. Vectors of unlike length count as if filled up with zeros. Of anchors with
an equal id the one with the smallest label, then place on the curve, counts; other rows with equal ids each count. A row with the anchor's id is never its positive.
Equal scores: the smaller id first. Scores are exact while they fit a long. Extra columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Rows of a block, anchors of a group, zone maps that a group is held against at a time, blocks of a tile, nearest blocks of the first pass.
BLOCK, GROUP, ZONES, TILE, SEEDS = 512, 512, 512, 64, 2
#: Bits of the curve for each dimension.
BITS = 2
LEAST, MOST = -(2**62), 2**62


def usable(rows: DataFrame, scale: int = 256) -> DataFrame:
    """id, label, v: components times ``scale``, rounded down, of the rows (id, label, embedding) that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole.alias("v"))


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Places along the curve, as bytes that sort like them, of cells (a row each, values under 2 ** bits)."""
    x = cells.astype(np.uint8).copy()
    for b in range(bits - 1, 0, -1):  # undo the turns of the sub-cubes, from the largest down
        low = np.uint8((1 << b) - 1)
        for i in range(x.shape[1]):
            high = (x[:, i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low).astype(np.uint8)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
    for i in range(1, x.shape[1]):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint8)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> b) & 1, (1 << b) - 1, 0).astype(np.uint8) if x.shape[1] else turn
    x ^= turn[:, None]
    planes = np.concatenate([(x >> b) & 1 for b in range(bits - 1, -1, -1)], axis=1)
    return [row.tobytes() for row in np.packbits(planes, axis=1)]


class Layout:
    """How vectors lie in bytes: dimensions, type, and whether scores are exact in doubles."""

    def __init__(self, dims: int, largest: int, step: float):
        self.dims, self.step = max(1, dims), step
        self.kind = np.int16 if largest < 2**15 else np.int64
        self.number = np.float64 if largest * largest * self.dims < 2**52 else np.int64
        self.none = -np.inf if self.number is np.float64 else np.iinfo(np.int64).min

    def vectors(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(-1, self.dims).astype(self.number)


def keyed(rows: DataFrame, layout: Layout) -> DataFrame:
    """id, label, key (place along the curve), v as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.zeros((batch.num_rows, layout.dims), np.int64)
            column = batch.column(2)
            lengths = np.diff(column.offsets.to_numpy())
            at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            v[np.repeat(np.arange(batch.num_rows), lengths), at] = column.flatten().to_numpy()
            cells = (v >= -layout.step).astype(np.uint8) + (v >= 0) + (v >= layout.step)
            made = [pa.array(hilbert_keys(cells), pa.binary()), pa.array([r.tobytes() for r in v.astype(layout.kind)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "label", "key", "v"])

    return rows.select("id", "label", "v").mapInArrow(run, "id bigint, label bigint, key binary, v binary")


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in tables of ``size``, the last one smaller."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            take = min(size - sum(b.num_rows for b in held), batch.num_rows)
            held.append(batch.slice(0, take))
            batch = batch.slice(take)
            if sum(b.num_rows for b in held) == size:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def bounds_of(v: np.ndarray) -> list[bytes]:
    return [v.min(axis=0).astype(np.int64).tobytes(), v.max(axis=0).astype(np.int64).tobytes()]


def along_curve(rows: DataFrame, n: int, size: int) -> DataFrame:
    """Rows in the order of label, curve, id, dealt by ranges of it; a label or a vector with very many rows is many ranges."""
    parts = max(1, math.ceil(n / (16 * size)))
    return rows.repartitionByRange(parts, "label", "key", "id").sortWithinPartitions("label", "key", "id")


def blocks_of(rows: DataFrame, n: int, layout: Layout, size: int) -> DataFrame:
    """block, label_lo, label_hi, lo, hi (the zone map), ids, labels, vectors; rows of a block by id."""
    kinds = "block bigint, label_lo bigint, label_hi bigint, lo binary, hi binary, ids binary, labels binary, vectors binary"
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for at, part in enumerate(gathered(batches, size)):
            part = part.sort_by("id")
            ids, labels = part["id"].to_numpy(), part["label"].to_numpy()
            raw = b"".join(part["v"].to_pylist())
            row = [(task << 32) + at, int(labels.min()), int(labels.max()), *bounds_of(layout.vectors(raw)), ids.tobytes(), labels.tobytes(), raw]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)

    return along_curve(rows.select("label", "key", "id", "v"), n, size).mapInArrow(run, kinds)


def groups_of(asked: DataFrame, n: int, layout: Layout, size: int) -> DataFrame:
    """group, ids, labels, vectors, owner (place of the anchor in the group), part, lo, hi (of each window); asked: id, label, key, v, windows."""
    kinds = "group bigint, ids binary, labels binary, vectors binary, owner binary, part binary, lo binary, hi binary"
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for at, rows in enumerate(gathered(batches, size)):
            windows = rows["windows"].to_pylist()
            owner = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
            fields = [np.array([w[f] for each in windows for w in each], np.int64) for f in ("part", "lo", "hi")]
            row = [(task << 32) + at, rows["id"].to_numpy().tobytes(), rows["label"].to_numpy().tobytes(), b"".join(rows["v"].to_pylist()), owner.tobytes(), *[f.tobytes() for f in fields]]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)

    return along_curve(asked.select("label", "key", "id", "v", "windows"), n, size).mapInArrow(run, kinds)


def long_array(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


class Group:
    """Anchors with their windows, and the best rows of each window so far."""

    def __init__(self, row: dict, layout: Layout, same: bool, k: int):
        self.layout, self.same, self.k = layout, same, k
        self.ids, self.labels, self.q = long_array(row["ids"]), long_array(row["labels"]), layout.vectors(row["vectors"])
        self.owner, self.part = long_array(row["owner"]), long_array(row["part"])
        self.lo, self.hi = (long_array(row[n]).astype(layout.number) for n in ("lo", "hi"))
        self.up, self.down = np.maximum(self.q, 0), np.minimum(self.q, 0)
        self.scores = np.full((len(self.owner), k), layout.none, layout.number)
        self.found = np.full((len(self.owner), k), LEAST, np.int64)

    def needs(self, lo: np.ndarray, hi: np.ndarray, label_lo: np.ndarray, label_hi: np.ndarray) -> np.ndarray:
        """Windows by zone maps: whether a score that the window still wants can lie between the bounds."""
        most, least = self.up @ hi.T + self.down @ lo.T, self.up @ lo.T + self.down @ hi.T
        label = self.labels[self.owner][:, None]
        fits = (label_lo <= label) & (label <= label_hi) if self.same else (label_lo != label) | (label_hi != label)
        return fits & (most[self.owner] >= np.maximum(self.lo, self.scores[:, -1])[:, None]) & (least[self.owner] <= self.hi[:, None])

    def take(self, row: dict) -> None:
        bound = lambda n: long_array(row[n]).astype(self.layout.number)[None, :]
        want = np.flatnonzero(self.needs(bound("lo"), bound("hi"), np.array([row["label_lo"]]), np.array([row["label_hi"]]))[:, 0])
        if not len(want):
            return
        ids, labels = long_array(row["ids"]), long_array(row["labels"])
        anchors, at = np.unique(self.owner[want], return_inverse=True)
        scores = (self.q[anchors] @ self.layout.vectors(row["vectors"]).T)[at]
        mine = self.owner[want]
        held = (labels[None, :] == self.labels[mine][:, None]) == self.same
        held &= (ids[None, :] != self.ids[mine][:, None]) & (scores <= self.hi[want][:, None])
        held &= scores >= np.maximum(self.lo[want], self.scores[want, -1])[:, None]
        some = held.any(axis=1)
        want, scores = want[some], np.where(held, scores, self.layout.none)[some]
        line = np.arange(len(want))
        best, other = [self.scores[want]], [self.found[want]]
        for _ in range(min(self.k, len(ids))):  # the first of equal scores has the smallest id
            col = scores.argmax(axis=1)
            best.append(scores[line, col][:, None])
            other.append(ids[col][:, None])
            scores[line, col] = self.layout.none
        best, other = np.concatenate(best, axis=1), np.concatenate(other, axis=1)
        order = np.lexsort((other, -best if self.layout.number is np.float64 else ~best), axis=1)[:, : self.k]
        self.scores[want], self.found[want] = np.take_along_axis(best, order, axis=1), np.take_along_axis(other, order, axis=1)

    def rows(self) -> pa.RecordBatch:
        w, c = np.nonzero(self.scores > self.layout.none)
        values = [self.ids[self.owner[w]], self.part[w], self.found[w, c], self.scores[w, c].astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["id", "part", "other", "score"])


def chosen(groups: DataFrame, blocks: DataFrame, n_blocks: int, layout: Layout, same: bool, k: int) -> DataFrame:
    """group, block, tile, near for the blocks that a group's windows must read; near: mean score of the anchors with the block's middle."""
    packs = max(1, math.ceil(n_blocks / ZONES))
    zone = F.struct("block", "label_lo", "label_hi", "lo", "hi")
    zones = blocks.groupBy(F.pmod(F.xxhash64("block"), F.lit(packs)).alias("pack")).agg(F.collect_list(zone).alias("zones"))
    pairs = groups.withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long")))).join(zones, "pack")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            group, zones = Group(row, layout, same, k), row["zones"]
            lo, hi = (long_array(b"".join(z[n] for z in zones)).reshape(len(zones), -1).astype(layout.number) for n in ("lo", "hi"))
            need = group.needs(lo, hi, *(np.array([z[n] for z in zones]) for n in ("label_lo", "label_hi")))
            middle = (group.q @ ((lo + hi) / 2).T)[group.owner]
            near = (middle * need).sum(axis=0) / np.maximum(need.sum(axis=0), 1)
            used = np.flatnonzero(need.any(axis=0))
            values = [pa.array([row["group"]] * len(used), pa.int64()), pa.array([zones[i]["block"] for i in used], pa.int64()), pa.array(near[used].astype(float), pa.float64())]
            yield pa.RecordBatch.from_arrays(values, ["group", "block", "near"])

    found = pairs.drop("pack").mapInArrow(run, "group bigint, block bigint, near double")
    tiles = max(1, math.ceil(n_blocks / TILE))
    return found.withColumn("tile", F.pmod(F.xxhash64("block"), F.lit(tiles)))


def read_tiles(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, layout: Layout, same: bool, k: int) -> DataFrame:
    """id, part, other, score: of each window the k best rows of each tile."""
    first = groups.join(pairs.select("group", "tile").distinct(), "group").withColumn("turn", F.lit(float("-inf")))
    then = pairs.join(blocks, "block").withColumn("turn", -F.col("near")).drop("near")
    rows = first.unionByName(then.withColumnsRenamed({"lo": "zone_lo", "hi": "zone_hi"}), allowMissingColumns=True)
    rows = rows.repartition("group", "tile").sortWithinPartitions("group", "tile", "turn", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            if row["block"] is None:
                if group:
                    yield group.rows()
                group = Group(row, layout, same, k)
            else:
                group.take(row | {"lo": row["zone_lo"], "hi": row["zone_hi"]})
        if group:
            yield group.rows()

    return rows.mapInArrow(run, "id bigint, part bigint, other bigint, score bigint")


def best_rows(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("id", "part").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(asked: DataFrame, n: int, blocks: DataFrame, n_blocks: int, layout: Layout, same: bool, k: int) -> DataFrame:
    """id, part, other, score, rank: the k best rows in each window of the anchors (id, label, key, v, windows)."""

    def one_pass(asked: DataFrame, nearest: int | None) -> DataFrame:
        groups = written(groups_of(asked, n, layout, GROUP), "anchor-groups")
        pairs = written(chosen(groups, blocks, n_blocks, layout, same, k), "anchor-blocks")
        if nearest:
            order = W.partitionBy("group").orderBy(F.desc("near"), "block")
            pairs = pairs.withColumn("at", F.row_number().over(order)).where(F.col("at") <= nearest).drop("at")
        return best_rows(read_tiles(pairs, groups, blocks, layout, same, k), k)

    if n_blocks > TILE:  # below, a group's blocks are one tile, which raises its windows as it goes
        seeds = one_pass(asked, SEEDS).groupBy("id", "part").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        raised = seeds.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("part", "least"))).alias("least"))
        lift = F.transform("windows", lambda w: F.struct(w.part.alias("part"), F.greatest(w.lo, F.coalesce(F.try_element_at("least", w.part), w.lo)).alias("lo"), w.hi.alias("hi")))
        asked = asked.join(raised, "id", "left").withColumn("windows", lift).drop("least")
    return one_pass(asked, None)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank (int), negative_id, positive_score, negative_score.

    rows: id, label, v (whole numbers). is_anchor: condition on them. A row of another label is a negative where its score is at least ``low`` and at most ``high``
    hundredths of the positive's; the first ``negatives`` count, for each of the first ``positives`` rows of the anchor's label."""
    absolute = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: F.greatest(s, F.abs(x)))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x))
    facts = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("v")).alias("dims"), F.max(absolute).alias("largest"), F.sum(total).alias("total"), F.sum(F.size("v")).alias("components")).first()
    layout = Layout(facts["dims"] or 0, facts["largest"] or 0, (facts["total"] or 0.0) / max(1, facts["components"] or 0))
    placed = keyed(rows, layout)
    blocks = written(blocks_of(placed, facts["n"], layout, block), "blocks")
    n_blocks = blocks.count()
    one = placed.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "key", "v")).alias("a")).select("id", "a.*")
    one = written(one, "anchors")
    window = lambda part, lo, hi: F.struct(part.cast("long").alias("part"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    first = search(one.withColumn("windows", F.array(window(F.lit(0), F.lit(LEAST), F.lit(MOST)))), facts["anchors"], blocks, n_blocks, layout, True, positives)
    first = written(first.select("id", "rank", "other", "score"), "positives")
    # rounded down, and in longs all the way
    hundredths = lambda share: F.expr(f"{share} * ((score - pmod(score, 100L)) DIV 100L) + floor({share} * pmod(score, 100L) / 100)")
    windows = first.select("id", window(F.col("rank"), -hundredths(-low), hundredths(high)).alias("w")).where("w.lo <= w.hi")
    asked = one.join(windows.groupBy("id").agg(F.sort_array(F.collect_list("w")).alias("windows")), "id")
    found = search(asked, facts["anchors"], blocks, n_blocks, layout, False, negatives)
    found = found.select(F.col("id").alias("anchor_id"), F.col("part").cast("int").alias("at"), "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    known = first.select(F.col("id").alias("anchor_id"), F.col("rank").alias("at"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(known, ["anchor_id", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def negatives_report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the rows of ``embeddings`` (vec_id, embedding, label) whose vec_id is divisible by 50; where it is divisible by 7 the label is the next of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").alias("id"), label.alias("label"), "embedding")
    return hard_negatives(usable(rows).where("id IS NOT NULL"), F.col("id") % 50 == 0)


ORACLE_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 a AS (SELECT * FROM r WHERE vec_id % 50 = 0),
 s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS other, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM a JOIN r ON a.vec_id <> r.vec_id),
 p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS n FROM s WHERE same) q WHERE n <= 5)
 SELECT anchor_id, positive_id, CAST(n AS INT) AS rank, negative_id, positive_score, negative_score FROM (SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS n FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score) t WHERE n <= 3"""
