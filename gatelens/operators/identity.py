"""Jobs over embeddings (id, plate, identity, embedding) and face measurements, and figures of evaluation.

Similarity is the dot product over the norms plus 1e-8. A null vector has no similarity and is dropped by joins that filter on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .percentiles import exact_percentiles
from .ranges import Ranges


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    x, y = F.col(a), F.col(b)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)) + F.lit(1e-8))


def plate_lookup_join(exits: DataFrame, active: DataFrame) -> DataFrame:
    """Every exit with the active entries of its plate in its lot, null if there is none."""
    known = active.select(F.col("id").alias("active_id"), "lot", "plate")
    return exits.select("id", "lot", "plate").join(known, ["lot", "plate"], "left").select("id", "lot", "plate", "active_id")


def cosine_verify(exits: DataFrame, active: DataFrame, least: float = 0.05) -> DataFrame:
    """id, active_id, sim (6 decimals), passed for exits whose plate is active."""
    both = exits.select("id", "plate", F.col("embedding").alias("a")).join(active.select(F.col("id").alias("active_id"), "plate", F.col("embedding").alias("b")), "plate")
    return both.select("id", "active_id", F.round(cosine("a", "b"), 6).alias("sim")).withColumn("passed", F.col("sim") >= least)


def quality_gate(faces: DataFrame, blur: float = 50.0) -> DataFrame:
    """image_id, ok, reason."""
    dark, bright = F.col("brightness") <= 30, F.col("brightness") >= 230
    reason = F.when(F.col("blur") < blur, "blurry").when(dark, "dark").when(bright, "bright").otherwise("ok")
    return faces.select("image_id", (reason == "ok").alias("ok"), reason.alias("reason"))


def quality_score(faces: DataFrame, blur: float = 50.0) -> DataFrame:
    """image_id, score; null where the gate fails."""
    score = 0.5 * F.least(F.col("blur") / 500, F.lit(1.0)) + 0.2 * (1 - F.abs(F.col("brightness") - 128) / 128) + 0.3 * F.least(F.col("w") * F.col("h") / F.lit(20000.0), F.lit(1.0))
    ok = (F.col("blur") >= blur) & (F.col("brightness") > 30) & (F.col("brightness") < 230)
    return faces.select("image_id", F.when(ok, score).alias("score"))


def face_status(faces: DataFrame) -> DataFrame:
    """status, n, share of images with one, no or several faces."""
    status = F.when(F.col("n_faces") == 1, "ok").when(F.col("n_faces") == 0, "no_face").otherwise("multi_face")
    n = faces.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all_n")))).select("status", "n", F.round(F.col("n") / F.col("all_n"), 6).alias("share"))  # three rows at most


def face_image_status(faces: DataFrame) -> DataFrame:
    """image_id, n_faces, status (ok, no_face, multi_face) of each image; an image without a count shows no face."""
    n = F.coalesce("n_faces", F.lit(0))
    return faces.select("image_id", n.alias("n_faces"), F.when(n == 1, "ok").when(n == 0, "no_face").otherwise("multi_face").alias("status"))


def first_n_per_group(rows: DataFrame, most: int = 2) -> DataFrame:
    order = W.partitionBy("identity").orderBy("id")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("identity", "id", "place")


def hash_rank(rows: DataFrame, seed: int) -> DataFrame:
    """id, at (place from 1 in md5 order), all_n; ranked over hash ranges, so no task sorts all."""
    keyed = rows.select("id", F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")).cast("binary")).alias("key")).withColumn("range", F.substring("key", 1, 3))
    sizes = keyed.groupBy("range").agg(F.count("*").alias("n"))  # 4,096 rows at most
    below = sizes.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("below"), F.sum("n").over(W.partitionBy()).alias("all_n"))
    place = F.col("below") + F.row_number().over(W.partitionBy("range").orderBy("key", "id"))
    return keyed.join(F.broadcast(below), "range").select("id", place.alias("at"), "all_n")


def split_hold_out(rows: DataFrame, seed: int = 42) -> DataFrame:
    """id, part: exactly a fifth (rounded down) of the rows in val, by md5 order."""
    return hash_rank(rows, seed).select("id", F.when(F.col("at") <= F.floor(F.col("all_n") * 0.2), "val").otherwise("train").alias("part"))


def latency_summary(timing: DataFrame, accuracy: int | None = None) -> DataFrame:
    """n, mean, std (population), min, max, p50, p95, p99 (interpolated), fps for each stage; 6 decimals. Percentiles are exact, by narrowing
    ranges; with an ``accuracy`` they come from one pass, and ranks are off by at most n / accuracy."""
    r = lambda c: F.round(c, 6)
    mean, shares = F.avg("ms"), [0.5, 0.95, 0.99]
    plain = timing.groupBy("stage").agg(F.count("ms").alias("n"), r(mean).alias("mean"), r(F.stddev_pop("ms")).alias("std"), F.min("ms").alias("low"), F.max("ms").alias("high"), r(F.when(mean > 0, 1000 / mean).otherwise(0.0)).alias("fps"), *([F.percentile_approx("ms", shares, accuracy).alias("cuts")] if accuracy else []))
    if not accuracy:
        exact = exact_percentiles(timing, F.col("stage"), F.col("ms"), shares).select("key", "cuts")
        plain = plain.join(exact, F.col("stage").eqNullSafe(F.col("key")), "left").drop("key")
    cuts = [r(F.get("cuts", F.lit(i))).alias(f"p{int(p * 100)}") for i, p in enumerate(shares)]
    return plain.select("stage", "n", "mean", "std", "low", "high", *cuts, "fps")


def value_histogram(timing: DataFrame, bins: int = 25) -> DataFrame:
    """bin, n over equal bins between the smallest and largest value, the last one closed."""
    span = timing.agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))  # one row
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("ms") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(0)
    return timing.where("ms IS NOT NULL").join(F.broadcast(span)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def edit_cer(reads: DataFrame) -> DataFrame:
    """event_id, dist, cer (6 decimals) of predicted against true strings; an empty truth counts as one character."""
    dist = F.levenshtein("base", "pred").cast("long")
    return reads.select("event_id", dist.alias("dist"), F.round(dist / F.greatest(F.length("base"), F.lit(1)), 6).alias("cer"))


def orientation_pick(images: DataFrame, order: tuple[int, ...] = (0, 1, 3, 2)) -> DataFrame:
    """image, code: the first orientation in order that shows a face; images without one have no row."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("code"))
    return images.where("n_faces > 0").groupBy("image").agg(F.min_by("code", place).alias("code"))


def embedding_avg(faces: DataFrame, width: int = 3, **cut) -> DataFrame:
    """image_id, lane, avg: unit mean of the last accepted vectors of the lane, weighted by quality (0.01 at least). Faces
    without quality are not accepted and have no row; a mean of norm 0 stays as it is. A lane with many faces is cut into ranges of time, each with the
    last vectors before it."""
    rows = faces.where("quality IS NOT NULL AND embedding IS NOT NULL").select("image_id", "lane", "ts", F.greatest("quality", F.lit(0.01)).alias("q"), F.col("embedding").cast("array<double>").alias("e"))
    ranges = Ranges(rows, "lane", "ts", **cut)
    order = ranges.window("ts", "image_id").rowsBetween(1 - width, 0)
    held = ranges.with_halo(width - 1, "ts", "image_id").withColumn("held", F.collect_list(F.struct("q", "e")).over(order)).where("NOT halo").select("image_id", "lane", "held")
    zero = F.transform(F.get("held", F.lit(0)).e, lambda x: F.lit(0.0))
    total = F.aggregate("held", zero, lambda s, h: F.zip_with(s, h.e, lambda x, y: x + y * h.q))
    weight = F.aggregate("held", F.lit(0.0), lambda s, h: s + h.q)
    mean = held.select("image_id", "lane", total.alias("total"), weight.alias("weight")).select("image_id", "lane", F.transform("total", lambda x: x / F.col("weight")).alias("mean"))
    norm = F.sqrt(dot(F.col("mean"), F.col("mean")))
    return mean.withColumn("norm", norm).select("image_id", "lane", F.when(F.col("norm") > 0, F.transform("mean", lambda x: x / F.col("norm"))).otherwise(F.col("mean")).alias("avg"))
