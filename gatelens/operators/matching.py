"""Greedy jobs within frames: suppression of overlapping boxes and one-to-one matching of predictions and truths.

A frame's boxes come from one detector call and are few, so a frame is one row with an array and a fold over it; frames are
spread over the cluster by frame_id. Boxes with null coordinates overlap nothing. Ties are settled by the numbers of the boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxes import iou_pair_join


def _overlap(a: Column, b: Column) -> Column:
    width = F.greatest(F.lit(0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    height = F.greatest(F.lit(0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    union = (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - width * height
    return F.when(union > 0, width * height / union).otherwise(0.0)


def nms(boxes: DataFrame, most: float = 0.45) -> DataFrame:
    """frame_id, det_id, conf of the boxes that no more confident kept box of the frame overlaps by more than ``most``."""
    box = F.struct((-F.col("conf")).alias("down"), "det_id", "x1", "y1", "x2", "y2")
    frames = boxes.groupBy("frame_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    none = F.filter("boxes", lambda b: F.lit(False))
    kept = F.aggregate("boxes", none, lambda held, b: F.when(F.exists(held, lambda k: F.coalesce(_overlap(k, b) > most, F.lit(False))), held).otherwise(F.concat(held, F.array(b))))
    return frames.select("frame_id", F.explode(kept).alias("b")).select("frame_id", "b.det_id", (-F.col("b.down")).alias("conf"))


def greedy_match(pairs: DataFrame, order: list[Column], *more: str) -> DataFrame:
    """frame_id, det_id, truth_id: pairs are taken in order, each box and each truth once; with the pair's columns ``more``."""
    pair = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "det_id", "truth_id", *more)
    frames = pairs.groupBy("frame_id").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    none = F.filter("pairs", lambda p: F.lit(False))
    taken = F.aggregate("pairs", none, lambda held, p: F.when(F.exists(held, lambda k: (k.det_id == p.det_id) | (k.truth_id == p.truth_id)), held).otherwise(F.concat(held, F.array(p))))
    return frames.select("frame_id", F.explode(taken).alias("p")).select("frame_id", "p.det_id", "p.truth_id", *[f"p.{c}" for c in more])


def prf_from_counts(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 (6 decimals) to tp, fp, fn; denominators are 1 and 1e-6 at least."""
    precision = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-6))
    return counts.select("*", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def detection_eval(boxes: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1. Boxes by falling confidence each take the free truth they overlap most."""
    pairs = iou_pair_join(boxes, truth, least).join(boxes.select("frame_id", "det_id", "conf"), ["frame_id", "det_id"])
    hits = greedy_match(pairs, [-F.col("conf"), F.col("det_id"), -F.col("iou"), F.col("truth_id")]).agg(F.count("*").alias("tp"))
    n, m = boxes.agg(F.count("*").alias("n")), truth.agg(F.count("*").alias("m"))  # one row each
    return prf_from_counts(hits.join(F.broadcast(n)).join(F.broadcast(m)).select("tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("m") - F.col("tp")).alias("fn")))


def matched_chars(boxes: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """frame_id, det_id, truth_id, ch, true_ch of the pairs of boxes and truths taken by falling overlap, each box and truth once."""
    pairs = iou_pair_join(boxes, truth, least, ch="ch", true_ch="ch")  # the characters go along, so that no table is joined again
    return greedy_match(pairs, [-F.col("iou"), -F.col("det_id"), -F.col("truth_id")], "ch", "true_ch")


def confusion_counts(boxes: DataFrame, truth: DataFrame, least: float = 0.5, most: int = 100) -> DataFrame:
    """truth, said, n: the ``most`` most frequent pairs of unlike characters over matched boxes, ties by truth, then said. A pair with a null character is
    left out. A character that no box matches shifts nothing: places in the string don't count."""
    unlike = matched_chars(boxes, truth, least).where("ch <> true_ch")
    counts = unlike.groupBy(F.col("true_ch").alias("truth"), F.col("ch").alias("said")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "truth", "said").limit(most)


def char_eval(boxes: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """frame_id, tp, fp, fn, cls_err, exact: pairs by falling overlap, whatever their characters; a pair of unlike characters
    is a class error. Frames with boxes or truths have a row."""
    said = matched_chars(boxes, truth, least)
    part = lambda df, **n: df.select("frame_id", *[n.get(c, F.lit(0)).cast("long").alias(c) for c in ("n", "m", "tp", "err")])
    same = F.col("ch").eqNullSafe(F.col("true_ch"))
    counts = part(boxes, n=F.lit(1)).unionByName(part(truth, m=F.lit(1))).unionByName(part(said, tp=same, err=~same))
    sums = counts.groupBy("frame_id").agg(*[F.sum(c).alias(c) for c in ("n", "m", "tp", "err")])
    hit = F.col("tp") + F.col("err")
    return sums.select("frame_id", "tp", (F.col("n") - hit).alias("fp"), (F.col("m") - hit).alias("fn"), F.col("err").alias("cls_err"), ((F.col("tp") == F.col("m")) & (F.col("n") == hit)).alias("exact"))


def char_prf(boxes: DataFrame, truth: DataFrame) -> DataFrame:
    """One row over all frames; a class error is one false positive and one false negative."""
    sums = char_eval(boxes, truth).agg(F.sum("tp").alias("tp"), F.sum(F.col("fp") + F.col("cls_err")).alias("fp"), F.sum(F.col("fn") + F.col("cls_err")).alias("fn"))
    return prf_from_counts(sums)


def decode_anchors(anchors: DataFrame, least: float = 0.4) -> DataFrame:
    """frame_id, at, cls, conf, x1, y1, x2, y2 from arrays cx, cy, w, h and scores (one array a class) of a frame's
    anchors: the best class of each, the first on ties."""
    parts = F.arrays_zip("cx", "cy", "w", "h")
    best = F.array_max("s")
    rows = anchors.select("frame_id", F.posexplode(parts).alias("at", "b"), "scores")
    rows = rows.select("frame_id", "at", "b", F.transform("scores", lambda c: F.get(c, F.col("at"))).alias("s")).withColumn("conf", best).where(F.col("conf") >= least)
    half = lambda c, side, sign: F.col(f"b.{c}") + sign * F.col(f"b.{side}") / 2
    return rows.select("frame_id", F.col("at").cast("long").alias("at"), (F.array_position("s", F.col("conf")) - 1).alias("cls"), "conf", half("cx", "w", -1).alias("x1"), half("cy", "h", -1).alias("y1"), half("cx", "w", 1).alias("x2"), half("cy", "h", 1).alias("y2"))
