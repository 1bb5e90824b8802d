"""SimHash fingerprints of texts, in column expressions, and the search for all fingerprints within a Hamming radius.

Terms are pairs of neighbouring words ``[^\\x20\\x09-\\x0D]+`` (the last word also alone), hashed to 64 bits; each
occurrence votes on each bit, so a term weighs as often as it occurs. A bit is set when more than half of the votes
are for it. Votes on four bits are added at once in the lanes of a long, in runs short enough for a lane.

The search cuts the 64 bits into blocks. Two fingerprints within the radius differ in at most so many blocks, so they
agree in one of the chosen sets of blocks; each set is a table keyed by its bits, and a pair is compared in the first table
that holds it. Equal fingerprints are searched once.

A null or empty text, or one without words, has fingerprint 0. Texts of any length are hashed whole. Rows are ordered by
(doc_id, text), null ids first, so repeated rows are neighbours and each keeps a row of its own. Extra columns are not read,
so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, let, written

#: Lanes of 16 bits in a long, and the number of votes that none of them can overflow.
LANES, RUN = 0x0001000100010001, 32_767


def fingerprints(rows: DataFrame, texts: list[str]) -> DataFrame:
    """Replaces each text column of ``texts`` by its 64-bit SimHash. The other columns must tell rows apart.

    A text becomes rows of neighbouring words that are summed up again in the same task where ``rows`` are already
    dealt by one of the other columns: the words of a text never travel."""
    others = [F.col(c) for c in rows.columns if c not in texts]
    words = F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), BLANKS)
    cut = rows.select(*others, F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("text")) for i, c in enumerate(texts)])).alias("of"))
    cut = cut.select(*others, "of.which", F.col("of.text").alias("text")).select(*others, "which", words.alias("words"))
    cut = cut.select(*others, "which", F.posexplode(F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))).alias("b"))).alias("at", "pair"))
    term = cut.select(*others, "which", F.floor(F.col("at") / RUN).cast("int").alias("run"), F.xxhash64("pair.a", "pair.b").alias("h"), (F.col("pair.a") != "").alias("any"))
    lane = lambda k: F.sum(F.when(F.col("any"), F.shiftrightunsigned("h", k).bitwiseAND(F.lit(LANES))).otherwise(F.lit(0))).alias(f"v{k}")
    runs = term.groupBy(*others, "which", "run").agg(F.count("*").alias("n"), *[lane(k) for k in range(16)])
    runs = runs.groupBy(*others).agg(F.collect_list(F.struct("which", "n", *[f"v{k}" for k in range(16)])).alias("runs"))
    of = lambda i: F.filter("runs", lambda r: r["which"] == i)
    return runs.select(*others, *[let(of(i), _bits).alias(c) for i, c in enumerate(texts)])


def _bits(runs: Column) -> Column:
    """The bits that have more than half of the votes of all runs."""
    n = F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + r["n"])
    out = F.lit(0).cast("long")
    for b in range(64):
        in_lane = lambda r, k=b % 16, lane=b // 16: F.shiftrightunsigned(r[f"v{k}"], 16 * lane).bitwiseAND(F.lit(0xFFFF))
        votes = F.aggregate(runs, F.lit(0).cast("long"), _adder(in_lane))
        out = out.bitwiseOR(F.when(votes * 2 > n, F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _adder(part):
    return lambda s, r: s + part(r)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _bucket_of(value: Column, splits: list) -> Column:
    """How many of the ascending split points are at most the value: a binary search in a literal array."""
    if not splits:
        return F.lit(0)
    points, n = F.array(*[F.lit(int(x)).cast("long") for x in splits]), len(splits)
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        return F.when(s["lo"] >= s["hi"], s).when(value >= F.get(points, mid), F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, step, lambda s: s["lo"])


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, rn, next_text, next_bucket, next_rn: every row and the one after it in (doc_id, text) order.

    Rows are dealt to ranges of ids, one text shuffle in all; the first rows of each range are also sent to the range before it
    (and the very first to the last), so every row finds the next one in its own range. The driver holds one id a range."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    splits = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    splits = sorted(set(splits or []))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_bucket_of(F.col("doc_id"), splits))
    firsts = {r["b"]: r["low"] for r in ids.groupBy(bucket.alias("b")).agg(F.min(F.struct("doc_id")).getField("doc_id").alias("low")).collect()}
    used = sorted(firsts)
    if not used:
        return docs.select("doc_id", "text", F.lit(0).alias("bucket"), F.lit(0).alias("rn"), F.lit("").alias("next_text"), F.lit(0).alias("next_bucket"), F.lit(0).alias("next_rn"))
    width = len(splits) + 1
    before = {b: used[i - 1] for i, b in enumerate(used)}
    after = {used[i - 1]: b for i, b in enumerate(used)}
    pick = lambda values, kind: F.get(F.array(*[F.lit(values.get(b)).cast(kind) for b in range(width)]), F.col("bucket"))
    rows = docs.select("doc_id", "text", bucket.alias("bucket"))
    guest = F.struct(pick(before, "int").alias("at"), (F.when(F.col("bucket") == used[0], 2).otherwise(1)).alias("guest"))
    own = F.struct(F.col("bucket").alias("at"), F.lit(0).alias("guest"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("doc_id").eqNullSafe(pick(firsts, "long")), F.array(own, guest)).otherwise(F.array(own))))
    rows = rows.select("doc_id", "text", F.col("to.at").alias("bucket"), F.col("to.guest").alias("guest"))
    order = W.partitionBy("bucket").orderBy("guest", "doc_id", "text")
    rows = rows.select("*", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next_text"), F.lead("guest").over(order).alias("next_guest")).where("guest = 0")
    stays = F.col("next_guest") == 0
    return rows.select("doc_id", "text", "bucket", "rn", "next_text", F.when(stays, F.col("bucket")).otherwise(pick(after, "int")).alias("next_bucket"), F.when(stays, F.col("rn") + 1).otherwise(F.lit(1)).alias("next_rn"))


def block_masks(radius: int, blocks: int) -> list[int]:
    """One mask for each set of blocks - radius blocks; bits are dealt to blocks in order, as evenly as they go."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """fp, other, bits: every pair of a query's fingerprint and any fingerprint (its own included) at most ``radius`` bits
    apart, once. Both tables: fp long, distinct. Tables hold distinct fingerprints only, so copies cost one row."""
    masks = block_masks(radius, blocks)
    keys = lambda c: F.array(*[F.struct(F.lit(i).alias("t"), F.col(c).bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks)])
    a = queries.select("fp", F.explode(keys("fp")).alias("key"))
    b = prints.select(F.col("fp").alias("other"), F.explode(keys("fp")).alias("key"))
    apart = F.col("fp").bitwiseXOR(F.col("other"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)) for i, m in enumerate(masks)])
    return a.join(b, "key").where((F.bit_count(apart) <= radius) & (first == F.col("key.t"))).select("fp", "other", F.bit_count(apart).alias("bits"))


def fingerprint_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near per input row.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next row's text.
    n_near: rows whose fingerprint is within ``radius`` bits, itself not counted, for ids divisible by 100, else null."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", "bucket", "rn", "next_bucket", "next_rn", n.cast("long").alias("n_chars"), F.col("text").alias("fp"), edited.alias("edited_fp"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited_fp", 256))
    base = written(fingerprints(rows, ["fp", "edited_fp"]), "fingerprints")
    prints = base.groupBy("fp").agg(F.count("*").alias("copies"), F.max(F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))).alias("asked"))
    near = within_radius(prints.where("asked").select("fp"), prints.select("fp"), radius)
    near = near.join(prints.select(F.col("fp").alias("other"), "copies"), "other").groupBy("fp").agg((F.sum("copies") - 1).alias("n_near"))
    asked = base.where("doc_id % 100 = 0").select("bucket", "rn", "fp").join(near, "fp").select("bucket", "rn", "n_near")
    following = base.select(F.col("bucket").alias("next_bucket"), F.col("rn").alias("next_rn"), F.col("fp").alias("next_fp"))
    out = base.join(following, ["next_bucket", "next_rn"], "left").join(asked, ["bucket", "rn"], "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hex_of(F.col("fp")).alias("fingerprint"), hex_of(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near"
    )
