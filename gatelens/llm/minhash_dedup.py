"""MinHash near-duplicates with sequential Bayesian verification: components of texts whose shingle sets are alike.

Texts are linked when 100 * |A & B| >= percent * |A | B| on their sets of ``shingle`` neighbouring words (the whole text if
it has fewer). Equal sets are one node. Nodes that share a band of their signature share a bucket; buckets with the same
members are one; nodes joined by buckets are a cluster, and no link crosses clusters. Inside a group, pairs are compared
by signature a batch of hashes at a time and given up as soon as the posterior probability that they are alike falls
below ``miss``; survivors are verified on the full sets, most alike first, and only while they are not joined yet.

A cluster of at most ``cluster_nodes`` nodes is worked on like one bucket, so its sets need not travel once a bucket; larger clusters
go bucket by bucket. What is over ``block`` nodes or ``block_bytes`` is worked on in blocks (``links_in_buckets``), so what a task
holds is bounded but for single long texts. All ways join the same nodes; results do not depend on the limits. Joins whose key may hold many rows (copies of a text, a bucket, a component) keep these
where they are (``join_hot``).

With 32 bands of 4 hashes a pair at the threshold of 0.8 is missed by all bands with probability 5e-8. Shingles and
nodes are 64-bit hashes. Nulls, empty texts and texts without words are linked with nothing. Texts of any length are
read whole. Rows that share an id are joined by it only if their sets are linked. Sets are found by their row, a hash of id and text, so
null and repeated ids lose no link. The smallest id stands for a component, null if it has none but null ids. The owner of a component is
its first row by id (null ids last), then by the row's hash: it alone is kept, with the rows that equal it in id and text. Rows without words
are all kept. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_hot, runs_of, written

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes compared before a pair may be given up, again and again.
BATCH = 32


class WordHashes(dict):
    def __init__(self, cache: int = 300_000):
        super().__init__()
        self.size = cache

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.size:
            self.clear()  # frequent words come back at once
        if len(word) <= 64:
            self[word] = h
        return h


def shingle_set(found: list[bytes], shingle: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's words."""
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    k = min(shingle, len(found))
    n = len(h) - k + 1
    mixed = np.full(n, k, np.uint64)
    for i in range(k):
        mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


@lru_cache(1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, np.uint64)


def signature(members: np.ndarray) -> np.ndarray:
    """The smallest of each of HASHES hashes over the set: the upper halves of a * x + b, 32 bits."""
    a, b = _multipliers()
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(members), 1024):
        x = members[at : at + 1024, None] * a
        x += b
        best = np.minimum(best, (x >> np.uint64(32)).astype(np.uint32).min(0))
    return best


@lru_cache(8)
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """For BATCH, 2 BATCH, ... compared hashes the fewest matches with which a pair stays: below, the posterior
    probability (uniform prior) that the similarity reaches the threshold is under ``miss``. Signatures keep 8 bits a hash, so a
    match has probability s + (1 - s) / 256."""
    t = percent / 100
    grid = (np.arange(2000) + 0.5) / 2000
    p = grid + (1 - grid) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            like = np.exp(m * np.log(p) + (n - m) * np.log1p(-p) - max(m * log(max(m, 1) / n) + (n - m) * log(max(n - m, 1) / n), -700))
            if like[grid >= t].sum() >= miss * like.sum():
                break
        out.append(m)
    return tuple(out)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test on two sorted sets."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def link_group(signatures: np.ndarray, sets: list[np.ndarray], percent: int, miss: float, joined: np.ndarray | None = None) -> np.ndarray:
    """For each node of a group the first node of its component; pairs of joined nodes are not verified again. joined: numbers of
    the components that are known already."""
    n = len(sets)
    root, known = np.arange(n), np.arange(n)
    if joined is not None:
        known = np.unique(joined, return_inverse=True)[1]
        root = np.unique(known, return_index=True)[1][known]
    keep = least_matches(percent, miss)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes = np.array([len(s) for s in sets])
    # a node with many alike ones comes first: what it joins need not be verified among themselves
    order = range(n)
    if n > 8:
        probe = signatures[np.linspace(0, n - 1, min(n, 64)).astype(int)]
        order = np.argsort(-np.array([int((signatures[i] == probe).sum()) for i in range(n)]), kind="stable").tolist()
    done = np.zeros(n, bool)
    for i in order:
        done[i] = True
        others = np.flatnonzero(~done & (known != known[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
        same = np.zeros(len(others), np.int64)
        for k, least in enumerate(keep):
            lo = k * BATCH
            same += (signatures[others, lo : lo + BATCH] == signatures[i, lo : lo + BATCH]).sum(1)
            stays = same >= least
            others, same = others[stays], same[stays]
            if not len(others):
                break
        for j in others[np.argsort(-same, kind="stable")].tolist():
            a, b = find(i), find(j)
            if a != b and alike(sets[i], sets[j], percent):
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def shingled(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, rid, n_shingles, node, sig (8 bits of each hash), bands (a hash of each ROWS hashes); nulls without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            size, node, sig, bands = [], [], [], []
            for text in batch.column(2).to_pylist():
                members = shingle_set(text.encode().lower().split() if text else [], shingle, hashes)
                size.append(len(members))
                if not len(members):
                    node.append(None)
                    sig.append(None)
                    bands.append(None)
                    continue
                node.append(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes())).astype(np.int64))
                s = signature(members)
                sig.append(s.astype(np.uint8).tobytes())
                key = salt.copy()
                for r in range(ROWS):
                    key = (key ^ s[r::ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(31)
                bands.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "rid", "n_shingles", "node", "sig", "bands"])

    return docs.mapInArrow(run, "doc_id bigint, rid bigint, n_shingles bigint, node bigint, sig binary, bands array<bigint>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node, members (the sorted shingle hashes, packed) for every text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            node, members = [], []
            for text in batch.column(0).to_pylist():
                found = shingle_set(text.encode().lower().split() if text else [], shingle, hashes)
                if len(found):
                    node.append(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))
                    members.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(members, pa.binary())], ["node", "members"])

    return docs.select("text").mapInArrow(run, "node bigint, members binary")


def links_in_groups(groups: DataFrame, percent: int, miss: float) -> DataFrame:
    """a, b for rows (gid, node, sig, members, known): each node of a group with the first of its component. Nodes with the same
    ``known`` are joined already, unless it is null; a node that comes twice counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle() -> pa.RecordBatch | None:
            once = [h for h, before in zip(held, [None, *held]) if before is None or h[0] != before[0]]
            if len(once) < 2:
                return None
            node = np.array([h[0] for h in once], np.int64)
            sig = np.frombuffer(b"".join(h[1] for h in once), np.uint8).reshape(len(once), HASHES)
            known = None if once[0][3] is None else np.array([h[3] for h in once], np.int64)
            root = link_group(sig, [np.frombuffer(h[2], np.uint64) for h in once], percent, miss, known)
            joined = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(node[joined]), pa.array(node[root[joined]])], ["a", "b"])

        for goes_on, part in runs_of(batches, "gid"):
            if not goes_on:
                if found := settle():
                    yield found
                held = []
            held += zip(*(part.column(i).to_pylist() for i in range(1, 5)))
        if found := settle():
            yield found

    dealt = groups.select("gid", "node", "sig", "members", "known").repartition("gid").sortWithinPartitions("gid", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def links_in_buckets(units: DataFrame, sets: DataFrame, percent: int, miss: float, block: int, block_bytes: int, pivots: int = 24) -> DataFrame:
    """a, b for the nodes of ``sets`` (node, sig, members), compared in each bucket of ``units`` (key, node, n, bytes) that they share.

    A bucket is dealt to blocks of about ``block`` nodes or ``block_bytes``. First each block is worked on by itself, with some
    ``pivots`` nodes of the bucket that come to all of its blocks, so that what is alike nearly everywhere is one component then. Pairs
    of one component need no more work. So in a second step only the nodes outside a bucket's largest component meet all the
    others of it, block by block: a set travels as often as there are blocks of such nodes, not as often as there are blocks."""
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / block_bytes)).cast("int")
    units = written(units.select("key", "node", "n", blocks.alias("blocks")), "units")
    spot = lambda seed, k: F.pmod(F.xxhash64("node", F.lit(seed)), k).cast("int")
    every = lambda k: F.sequence(F.lit(0), k - 1)
    with_sets = lambda rows: rows.hint("merge").join(sets.select("node", "sig", "members"), "node")

    to = F.when(spot(3, F.col("n")) < pivots, every(F.col("blocks"))).otherwise(F.array(spot(2, F.col("blocks"))))
    first = units.select("node", "key", F.explode(to).alias("j")).select("node", F.xxhash64("key", "j").alias("gid"), F.lit(None).cast("bigint").alias("known"))
    links = written(links_in_groups(with_sets(first), percent, miss), "links-in-blocks")

    split = units.where("blocks > 1")
    if split.isEmpty():
        return links
    comps = connected_components(links)
    placed = written(split.join(comps, "node", "left").select("key", "node", "blocks", F.coalesce("comp", "node").alias("known")), "placed")
    largest = placed.groupBy("key", "known").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "known")).alias("top"), F.sum("m").alias("n"))
    largest = largest.select("key", "n", F.col("top.known").alias("main"), (F.lit(1) - F.col("top.m") / F.col("n")).alias("apart")).where("apart > 0")
    rows = join_hot(placed, written(largest, "largest"), "key")
    rest = F.ceil(F.col("apart") * F.col("blocks")).cast("int")
    group = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    as_other = F.transform(every(rest), lambda i: group(i, spot(2, F.col("blocks"))))
    as_apart = F.when(F.col("known") != F.col("main"), F.transform(every(F.col("blocks")), lambda j: group(spot(4, rest), j))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    second = rows.select("node", "known", "key", F.explode(F.concat(as_other, as_apart)).alias("to"))
    second = second.select("node", "known", F.xxhash64("key", "to.i", "to.j").alias("gid"))
    return links.unionByName(links_in_groups(with_sets(second), percent, miss))


def row_hash(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """One hash of a row's id and text; nulls have hashes as well."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, miss: float = 1e-6, cluster_nodes: int = 4_000, block: int = 200, block_bytes: int = 32_000_000) -> DataFrame:
    """doc_id, rid, n_shingles, component_id, owner for every row: the row hash of its component's owner, null without words."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(id_col, text_col).alias("rid"), F.col(text_col).cast("string").alias("text"))
    base = written(shingled(docs, shingle), "shingled")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    nodes = base.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), low.alias("low"), (F.first("n_shingles") * 8).alias("bytes"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes")
    bands = nodes.select("node", "bytes", F.explode("bands").alias("key"))
    # buckets of two nodes or more; those with the same members count once
    same = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"x{seed}") for seed in (0, 1)]
    buckets = bands.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("node").alias("lo"), F.max("node").alias("hi"), *same).where("n > 1")
    buckets = buckets.groupBy("n", "lo", "hi", "x0", "x1").agg(F.min("key").alias("key"), F.min("bytes").alias("bytes"))
    buckets = written(buckets.select("key", "n", "bytes", F.col("lo").alias("first")), "buckets")
    # bands are far more than buckets at any size, so they are dealt by key even where so few buckets could be broadcast
    members = written(join_hot(bands.drop("bytes"), buckets.hint("merge"), "key").select("key", "node", "n", "bytes", "first"), "members")
    clusters = connected_components(members.select(F.col("node").alias("a"), F.col("first").alias("b")))
    owners = written(clusters.join(nodes.select("node", F.col("low.rid").alias("rid"), "bytes", "sig"), "node"), "owners")
    weights = owners.groupBy("comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    placed = written(join_hot(owners.select("node", "comp"), weights, "comp"), "placed")
    # the texts are dealt by row, even where so few are wanted that their rows could be broadcast
    sets = full_sets(docs.join(owners.select("rid").hint("shuffle_hash"), "rid", "left_semi"), shingle).dropDuplicates(["node"])
    ready = written(owners.select("node", "sig").join(sets, "node"), "sets")
    in_one = F.col("n") <= cluster_nodes
    units = placed.where(in_one).select(F.col("comp").alias("key"), "node", "n", "bytes")
    units = units.unionByName(members.join(placed.where(~in_one).select("node"), "node", "left_semi").select("key", "node", "n", "bytes"))
    links = links_in_buckets(units, ready, percent, miss, block, block_bytes)
    comps = connected_components(links)
    lows = written(nodes.join(comps, "node", "left").select("node", "n", "low", F.coalesce("comp", "node").alias("comp")), "lows")
    firsts = lows.groupBy("comp").agg(F.min("low").alias("first"), F.count("*").alias("n"))
    lows = join_hot(lows.select("node", "comp", F.col("n").alias("rows")), firsts, "comp")
    lows = written(lows.select("node", F.col("rows").alias("n"), F.col("first.doc_id").alias("component_id"), F.col("first.rid").alias("owner")), "lows")
    has_words = join_hot(base.where("node is not null").select("node", "doc_id", "rid", "n_shingles"), lows, "node").select("doc_id", "rid", "n_shingles", "component_id", "owner")
    none = base.where("node is null").select("doc_id", "rid", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("owner"))
    return has_words.unionByName(none)


def near_duplicates(df: DataFrame, *args, **limits) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) for every row; arguments as in ``components``. A row without
    an id is never kept; to keep one row of each group where ids are null or repeated, take the owner of ``components``."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return components(df, *args, **limits).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


#: DuckDB SQL for op5's rows over ``documents``: shingles counted pair by pair, components by a recursive walk.
ORACLE_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
walk AS (SELECT doc_id, doc_id AS reached FROM docs UNION SELECT doc_id, b FROM walk JOIN links ON a = reached),
comps AS (SELECT doc_id, min(reached) AS component_id FROM walk GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM docs JOIN comps USING (doc_id) LEFT JOIN sizes USING (doc_id)"""
