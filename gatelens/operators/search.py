"""Similarity search over embeddings (id, plate, identity, embedding): best matches, similar pairs, Top-1, pruning.

The best of all rows and all pairs over a threshold go by way of a metric index (``angles``). Vectors are compared in blocks: both sides are dealt by the hash of their id into blocks of about ``size`` rows, every pair of
blocks is one matrix product in one task, and only what passes leaves it: the best ``k`` of a row or the pairs on one side
of a threshold. Where a key must be equal, blocks are made within the key, so a key with a third of all rows is many blocks.
Rows with null vectors take no part. Similarities are of unit length vectors, in doubles; ties go to the smaller id."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import folder, written
from . import angles

#: (similarities, ids of the rows, ids of the columns) -> which to keep
Keep = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def best(k: int) -> Keep:
    """The k best of each row, and whatever equals the last of them."""

    def keep(sims: np.ndarray, _a: np.ndarray, _b: np.ndarray) -> np.ndarray:
        if sims.shape[1] <= k:
            return np.ones(sims.shape, bool)
        return sims >= np.partition(sims, -k, axis=1)[:, -k][:, None] - 1e-6  # equal in six decimals

    return keep


def over(least: float) -> Keep:
    return lambda sims, a, b: sims >= least


def pairs_up_to(most: float) -> Keep:
    """Pairs of one table, each once, that are no more alike than ``most``."""
    return lambda sims, a, b: (sims <= most) & (a[:, None] < b[None, :])


def compared(a: DataFrame, b: DataFrame, on: list[str], keep: Keep) -> DataFrame:
    """a, b, sim of what ``keep`` lets through of the products of blocks; both sides: id, v and the columns ``on`` that name a pair of blocks."""

    def product(rows: pd.DataFrame, columns: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(columns):
            return pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": "int64", "b": "int64", "sim": "float64"})
        unit = lambda df: (m := np.stack(df["v"].to_numpy())) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        sims = unit(rows) @ unit(columns).T
        ids, others = rows["id"].to_numpy(), columns["id"].to_numpy()
        r, c = np.nonzero(keep(sims, ids, others))
        return pd.DataFrame({"a": ids[r], "b": others[c], "sim": sims[r, c]})

    return a.groupBy(*on).cogroup(b.groupBy(*on)).applyInPandas(product, "a long, b long, sim double")


def matched(left: DataFrame, right: DataFrame, keep: Keep, key: str | None = None, size: int = 2048) -> DataFrame:
    """a, b (ids of left and right), sim for what ``keep`` lets through, within equal keys if a key is named."""
    shape = lambda df: df.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), (F.col(key) if key else F.lit(0)).alias("k"), F.col("embedding").cast("array<double>").alias("v"))
    a, b = shape(left), shape(right)
    blocks = lambda df, name: df.groupBy("k").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    plan = blocks(a, "rows").join(blocks(b, "columns"), "k")
    deal = lambda over: F.pmod(F.xxhash64("id"), F.col(over)).cast("int")
    every = lambda over: F.explode(F.sequence(F.lit(0), F.col(over) - 1))
    a = a.join(plan, "k").withColumn("i", deal("rows")).select("k", "i", every("columns").alias("j"), "id", "v")
    b = b.join(plan, "k").withColumn("j", deal("columns")).select("k", every("rows").alias("i"), "j", "id", "v")
    return compared(a, b, ["k", "i", "j"], keep)


def near(left: DataFrame, right: DataFrame, keep: Keep, k: int | None, least: float, size: int = 2048) -> DataFrame:
    """As ``matched`` without a key, for the best ``k`` that reach ``least`` (or all that do), by way of the metric index: each row goes
    only to the blocks that can hold an answer."""
    found = angles.routes(left, right, keep, k, least, size)
    return compared(*found, ["c", "i", "d", "j"], keep) if found else matched(left, right, keep, size=size)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each row over all blocks, with rank and six decimals."""
    order = W.partitionBy("a").orderBy(F.desc("sim"), "b")
    return found.withColumn("sim", F.round("sim", 6)).distinct().withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def topk_similar(exits: DataFrame, active: DataFrame, k: int = 3, least: float = 0.15) -> DataFrame:
    """id, rank, active_id, sim: the k most alike active rows, of these the ones that reach ``least``."""
    return ranked(near(exits, active, best(k), k, least), k).where(F.col("sim") >= least).select(F.col("a").alias("id"), "rank", F.col("b").alias("active_id"), "sim")


def cross_similarity(exits: DataFrame, active: DataFrame, least: float = 0.3) -> DataFrame:
    """id, active_id, sim for all pairs that reach ``least``."""
    found = near(exits, active, over(least - 1e-6), None, least).select(F.col("a").alias("id"), F.col("b").alias("active_id"), F.round("sim", 6).alias("sim"))
    return found.where(F.col("sim") >= least)


def low_pairs(rows: DataFrame, most: float = -0.2) -> DataFrame:
    """identity, i, j, sim of the pairs of one identity that are no more alike than ``most``."""
    found = matched(rows, rows, pairs_up_to(most + 1e-6), "identity")
    owner = rows.select(F.col("id").cast("long").alias("a"), "identity")
    return found.join(owner, "a").select("identity", F.col("a").alias("i"), F.col("b").alias("j"), F.round("sim", 6).alias("sim")).where(F.col("sim") <= most)


def low_sim_pairs(rows: DataFrame, most: float = -0.2) -> DataFrame:
    """One row: n_pairs of equal identity, n_low of them, their share, identities hit, and lowest, mean and highest similarity of the low ones."""
    sizes = rows.where("embedding IS NOT NULL").groupBy("identity").count()
    pairs = sizes.agg(F.coalesce(F.sum(F.expr("count * (count - 1) DIV 2")), F.lit(0)).alias("n_pairs"))
    low = low_pairs(rows, most).agg(F.count("*").alias("n_low"), F.count_distinct("identity").alias("identities"), F.min("sim").alias("lowest"), F.round(F.avg("sim"), 6).alias("mean"), F.max("sim").alias("highest"))
    share = F.round(F.col("n_low") / F.greatest(F.col("n_pairs"), F.lit(1)), 6)
    return low.join(F.broadcast(pairs)).select("n_pairs", "n_low", share.alias("share"), "identities", "lowest", "mean", "highest")  # one row each


def lowest_pairs(rows: DataFrame, most: float = -0.2, shown: int = 15) -> DataFrame:
    """The ``shown`` pairs of one identity that are least alike, of those that are no more alike than ``most``."""
    return low_pairs(rows, most).orderBy("sim", "identity", "i", "j").limit(shown)


def gallery_probe_split(rows: DataFrame, seed: int = 7) -> DataFrame:
    """identity, gallery, probe: two ids of every identity that has two or more, by md5 order."""
    key = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")).cast("binary"))
    place = F.row_number().over(W.partitionBy("identity").orderBy(key, "id"))
    two = rows.select("identity", "id", place.alias("place")).where("place <= 2")
    pick = lambda n: F.max(F.when(F.col("place") == n, F.col("id")))
    return two.groupBy("identity").agg(pick(1).alias("gallery"), pick(2).alias("probe")).where("probe IS NOT NULL")


def top1_rows(rows: DataFrame, seed: int = 7) -> DataFrame:
    """identity, said, true_sim, said_sim, imposter_sim for the probe of each identity against all gallery rows."""
    split = gallery_probe_split(rows, seed)
    vec = rows.select("id", "embedding")
    gallery = split.select("identity", F.col("gallery").alias("id")).join(vec, "id")
    probes = split.select("identity", F.col("probe").alias("id")).join(vec, "id")
    two = ranked(near(probes, gallery, best(2), 2, -2.0), 2)
    names = gallery.select(F.col("id").alias("b"), F.col("identity").alias("said"))
    asked = probes.select(F.col("id").alias("a"), "identity")
    two = two.join(names, "b").join(asked, "a")
    first = F.col("rank") == 1
    top = two.groupBy("identity").agg(F.max(F.when(first, F.col("said"))).alias("said"), F.max(F.when(first, F.col("sim"))).alias("said_sim"), F.max(F.when(F.col("said") != F.col("identity"), F.col("sim"))).alias("imposter_sim"))
    true = matched(probes, gallery, over(-2.0), "identity").join(asked, "a").select("identity", F.round("sim", 6).alias("true_sim"))
    return top.join(true, "identity").select("identity", "said", "true_sim", "said_sim", "imposter_sim")


def top1_accuracy(rows: DataFrame) -> DataFrame:
    """One row: n, correct, acc, mean_genuine, mean_imposter."""
    r = lambda c: F.round(F.avg(c), 6)
    right = F.col("said") == F.col("identity")
    return top1_rows(rows).agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), r(right.cast("double")).alias("acc"), r("true_sim").alias("mean_genuine"), r("imposter_sim").alias("mean_imposter"))


def top_mismatches(rows: DataFrame, most: int = 15) -> DataFrame:
    """The wrong answers by falling margin over the true similarity."""
    wrong = top1_rows(rows).where("said <> identity").withColumn("margin", F.round(F.col("said_sim") - F.col("true_sim"), 6))
    return wrong.orderBy(F.desc("margin"), "identity").limit(most).select("identity", "said", "true_sim", "said_sim", "margin")


def same_diff_pairs(rows: DataFrame, most: int = 100) -> DataFrame:
    """a, b, same, sim: the first two of an identity, and the first of an identity with the first of the next; ``most`` identities."""
    place = F.row_number().over(W.partitionBy("identity").orderBy("id"))
    two = rows.select("identity", "id", "embedding", place.alias("place")).where("place <= 2")
    firsts = two.where("place = 1").orderBy("identity").limit(most)
    other = F.lead("id").over(W.orderBy("identity"))  # over at most ``most`` rows
    diff = firsts.select(F.col("id").alias("a"), other.alias("b")).where("b IS NOT NULL").withColumn("same", F.lit(False))
    pairs = two.where("place = 2").select("identity", F.col("id").alias("b")).join(firsts.select("identity", F.col("id").alias("a")), "identity").select("a", "b", F.lit(True).alias("same")).unionByName(diff)
    vec = lambda n: two.select(F.col("id").alias(n), F.col("embedding").cast("array<double>").alias("v" + n))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(vec("a"), "a").join(vec("b"), "b").select("a", "b", "same", F.round(dot, 6).alias("sim"))


def at_most(sims: np.ndarray, most: float) -> np.ndarray:
    """Which similarities are ``most`` (negative) or less in six decimals."""
    return sims <= (round(most * 1e6) + 0.5) / 1e6


def low_degrees(rows: DataFrame, most: float, size: int = 2048) -> DataFrame:
    """identity, id, deg: with how many rows of its identity a row is no more alike than ``most``, of those with one or more. Counted block by block; pairs of blocks
    that mirror each other are computed once, and no pair leaves its block."""
    rows = rows.where("embedding IS NOT NULL").select("identity", F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    plan = rows.groupBy("identity").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = rows.join(plan, rows["identity"].eqNullSafe(plan["identity"])).drop(plan["identity"]).where("identity IS NOT NULL").withColumn("mine", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    held = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("identity", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "v")

    def count(block: pd.DataFrame) -> pd.DataFrame:
        i, j = block["i"].iloc[0], block["j"].iloc[0]
        m = np.stack(block["v"].to_numpy())
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        first = (block["mine"] == i).to_numpy()
        low = at_most(m[first] @ m[~first].T, most) if i < j else at_most(m @ m.T, most)
        deg = np.zeros(len(m), np.int64)
        if i < j:
            deg[first], deg[~first] = low.sum(axis=1), low.sum(axis=0)
        else:
            np.fill_diagonal(low, False)
            deg = low.sum(axis=1)
        some = deg > 0
        return pd.DataFrame({"identity": block["identity"][some], "id": block["id"][some], "deg": deg[some]})

    kind = rows.schema["identity"].dataType.simpleString()
    counts = held.groupBy("identity", "i", "j").applyInPandas(count, f"identity {kind}, id long, deg long")
    return counts.groupBy("identity", "id").agg(F.sum("deg").alias("deg"))


def sums_of(vectors: DataFrame) -> DataFrame:
    """identity, n (rows), s: the sum of an identity's vectors, each place added up by itself."""
    places = vectors.select("identity", F.posexplode("v").alias("at", "x")).groupBy("identity", "at").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    total = places.groupBy("identity").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s"))
    return total.select("identity", "n", F.transform("s", lambda p: p.x).alias("s"))


def outlier_prune(rows: DataFrame, most: float = -0.2, bound: int = 1_000_000) -> DataFrame:
    """identity, id, reason of the rows to remove until no pair of an identity is as unlike as ``most``: of the two images of
    an identity both; else by turns the one with the most such pairs, the least alike on average on ties, then the smaller id.

    Pairs are counted in blocks, spread over the cluster, and never written. A turn changes the next, so an identity's turns are one task's work: it
    holds the vectors of the rows that have such a pair, and their counts, and finds the pairs of the row that goes by one product with them,
    ``bound`` similarities at a time."""
    degrees = written(low_degrees(rows, most), f"{folder(rows.sparkSession, 'prune')}/degrees")
    vectors = rows.where("embedding IS NOT NULL").select("identity", F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    first = degrees.groupBy("identity").agg(F.min("id").alias("first"))  # the sum of an identity's vectors is sent with one row
    facts = degrees.join(vectors, ["identity", "id"]).join(sums_of(vectors), "identity").join(first, "identity")
    facts = facts.select("identity", "id", "v", F.when(F.col("id") == F.col("first"), F.col("s")).alias("s"), "n", "deg")

    def prune(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("id")
        who, ids, degree, left = nodes["identity"].iloc[0], nodes["id"].to_numpy(), nodes["deg"].to_numpy(copy=True), int(nodes["n"].iloc[0])
        if left == 2:
            return pd.DataFrame({"identity": who, "id": ids, "reason": "both"})
        m, rest = np.stack(nodes["v"].to_numpy()), nodes["s"].iloc[0].copy()
        norms, own = np.linalg.norm(m, axis=1, keepdims=True), (m**2).sum(axis=1)
        unit, at, out = m / np.maximum(norms, 1e-12), np.arange(len(ids)), []
        while (top := degree[at].max(initial=0)) > 0:
            tied = at[degree[at] == top]  # by rising id, so the first of equal means is the smaller
            gone = tied[np.argmin((m[tied] @ rest - own[tied]) / max(left - 1, 1))]
            out.append((who, int(ids[gone]), f"bad {top}"))
            rest, left = rest - m[gone], left - 1
            degree[gone] = 0
            for start in range(0, len(at), bound):
                part = at[start : start + bound]
                degree[part] -= at_most(unit[start : start + bound] @ (m[gone] / max(norms[gone, 0], 1e-12)), most) & (degree[part] > 0)
            if 2 * np.count_nonzero(degree[at]) < len(at):  # rows without pairs need no more comparisons
                at = at[degree[at] > 0]
                unit = m[at] / np.maximum(norms[at], 1e-12)
        return pd.DataFrame(out, columns=["identity", "id", "reason"])

    kind = rows.schema["identity"].dataType.simpleString()
    return facts.groupBy("identity").applyInPandas(prune, f"identity {kind}, id long, reason string")
