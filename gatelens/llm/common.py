"""What the training-data operators share: tables, words, bounded caches, written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Java and Python form of what separates words: space and \x09-\x0D. ``bytes.split()`` splits at the same six bytes.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8."""
    return text.encode().split() if text else []


_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Where the session names none, one is made if driver and tasks are one process; a
    cluster has to name one."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not re.fullmatch(r"local(\[.*\])?", master := spark.conf.get("spark.master", "")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _OWN_DIR[0]


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows, written once to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")  # what this query has shuffled is not read again once the table is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def add_columns(df: DataFrame, text_col: str, keep: list[str] | None, new: str, make: Callable[[], Callable[[list], list[pa.Array]]]) -> DataFrame:
    """``keep`` (all columns if None), then the columns of the DDL ``new``, computed from the texts of a batch.

    ``make`` runs once a task and gives the function of a batch's texts. Kept columns whose names clash with new ones
    are replaced. The text travels back only if it is kept."""
    added = StructType.fromDDL(new)
    taken = {n.lower() for n in added.names}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    # tasks see numbers for names: any column name may come, with dots in it or in use already
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType([*(StructField(f"c{i}", rows.schema[i].dataType) for i in range(len(keep))), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            made = each(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], schema.names)

    return rows.mapInArrow(run, schema).toDF(*keep, *added.names)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once: the only element of an array, bound by a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: Steps of a scan: an array has fewer than 2 ** 31 elements.
POWERS = [1 << k for k in range(31)]


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element ``op`` (associative) over it and all before it: each round reaches twice as far back, so an array of n
    elements is rewritten log n times and never once an element."""

    def doubled(found: Column, far: Column) -> Column:
        return F.transform(found, lambda x, i: F.when(i >= far, op(F.get(found, i - far), x)).otherwise(x))

    def rounds(v: Column) -> Column:
        return F.aggregate(F.filter(F.lit(POWERS), lambda far: far < F.size(v)), v, doubled)

    return let(values, rounds)


class TwoGenerations:
    """A bounded cache: when the young half is full the old half is forgotten, what is used in between stays."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        if (found := self.young.get(key)) is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


def frequent_pieces(df: DataFrame, text_col: str, cut: Callable[[str], list], size: int, longest: int = 32, sampled: int = 20_000, tasks: int = 8) -> list[bytes]:
    """At most ``size`` frequent pieces, the most frequent first; ties by the piece.

    They are counted over about ``sampled`` rows drawn from all of the table, for they only steer caches and codes and
    never decide a value. So whatever the table's size, what is dealt to the ``tasks`` is that many texts, each task hands the
    driver at most ``size`` pieces of at most ``longest`` bytes, and no pre-token is ever shuffled."""
    texts = df.select(F.col(text_col).cast("string").alias("text")).where("text <> ''")
    share = min(1.0, sampled / max(1, df.count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(cut(text))
        top = ((k if isinstance(k, bytes) else k.encode(), n) for k, n in seen.most_common())
        top = list(islice(((k, n) for k, n in top if 0 < len(k) <= longest), size))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    drawn = texts if share == 1.0 else texts.sample(share, seed=17)
    total: Counter = Counter()
    for row in drawn.repartition(tasks).mapInArrow(count, "piece binary, n bigint").collect():  # at most tasks * size rows
        total[bytes(row.piece)] += row.n
    return sorted(total, key=lambda k: (-total[k], k))[:size]


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of sorted batches with one key each, and whether a slice goes on with the key of the one before it."""
    import numpy as np

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            yield keys[lo] == last, batch.slice(lo, hi - lo)
            last = keys[lo]


#: A key that holds more than one in HOT rows is hot, so there are fewer than HOT such keys, whatever the table's size.
HOT = 1000


def join_hot(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", hot: bool | None = None) -> DataFrame:
    """``rows`` joined (inner or left_semi) with ``facts``: one row a key, with a column ``n``, how many of ``rows`` it has (roughly).

    Facts of hot keys are broadcast, fewer than HOT of them; so rows of a hot key stay where they are, and all the others meet
    their facts in a shuffle in which no key has more than one in HOT rows. Where no key is hot, or ``hot`` says so, it is a plain join."""
    held = facts.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first() if hot is not False else None
    if held is None or (held["most"] or 0) * HOT <= (held["all"] or 0):
        return rows.join(facts, key, how)
    is_hot = F.col("n") * HOT > held["all"]
    few = F.broadcast(facts.where(is_hot))
    return rows.join(few, key, how).unionByName(rows.join(few.select(key), key, "left_anti").join(facts.where(~is_hot), key, how))


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, comp for every node of the links (a long, b long): comp is the smallest node that can be reached.

    Large-star and small-star steps in turn: every step joins each node's neighbours to the smallest of them, so a
    component becomes a star in a number of rounds that grows with the logarithm of its size. No group is collected: a node's
    smallest neighbour is an aggregate that is joined back, by ``join_hot`` where some node has very many neighbours. Each round is
    written to the shared folder."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up, down = F.count_if(F.col("b") > F.col("a")), F.count_if(F.col("b") < F.col("a"))
        nodes = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), up.alias("n"), down.alias("down"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
        now = nodes.agg(F.sum("n").alias("all"), F.max("n").alias("up"), F.max("down").alias("down"), F.bit_xor("x").alias("x")).first()
        if now["all"] is None or (now["all"], now["x"]) == mark:
            break
        mark = (now["all"], now["x"])
        up_hot, down_hot = now["up"] * HOT > now["all"], now["down"] * HOT > now["all"]
        least = nodes.where("n > 0").select("a", "m", "n")  # a node that is larger than all its neighbours has none to hand on
        least = written(least, "least") if up_hot else least
        large = join_hot(both.where("b > a"), least, "a", hot=up_hot).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large") if down_hot else large
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        least = written(least, "least") if down_hot else least  # a node has no more smaller neighbours now than before
        ends = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = join_hot(large, least, "a", hot=down_hot).select(F.explode(ends).alias("e")).select("e.a", "e.b")
        edges = written(small.where("a <> b").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
