"""Jobs over detection boxes (frame_id, det_id, x1, y1, x2, y2, conf): filters, geometry, best box, overlap pairs.

Null coordinates or confidences drop a box from filters and give null geometry; equal confidences go to the lower det_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def conf_filter(boxes: DataFrame, least: float = 0.4) -> DataFrame:
    return boxes.where(F.col("conf") >= least)


def box_geometry(boxes: DataFrame) -> DataFrame:
    """Adds centre and size to corner boxes."""
    return boxes.select("*", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))


def box_clamp(boxes: DataFrame, width: int = 200, height: int = 100) -> DataFrame:
    """Clips boxes to the image; those without area are dropped."""
    clip = lambda c, top: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(top)).alias(c)
    return boxes.select("frame_id", "det_id", clip("x1", width), clip("y1", height), clip("x2", width), clip("y2", height), "conf").where("x2 > x1 AND y2 > y1")


def box_margin_clip(boxes: DataFrame, width: int = 300, height: int = 200) -> DataFrame:
    """Grows a box by 8 % of its width (10 at least) and 12 % of its height (8 at least), clips it, flags empty ones."""
    mx = F.greatest(F.lit(10), (0.08 * (F.col("x2") - F.col("x1"))).cast("int"))
    my = F.greatest(F.lit(8), (0.12 * (F.col("y2") - F.col("y1"))).cast("int"))
    grown = boxes.select("frame_id", "det_id", F.greatest(F.lit(0), F.col("x1") - mx).alias("x1"), F.greatest(F.lit(0), F.col("y1") - my).alias("y1"), F.least(F.lit(width), F.col("x2") + mx).alias("x2"), F.least(F.lit(height), F.col("y2") + my).alias("y2"))
    return grown.withColumn("empty", (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")))


def best_box(boxes: DataFrame) -> DataFrame:
    """The most confident box of each frame."""
    order = W.partitionBy("frame_id").orderBy(F.desc_nulls_last("conf"), "det_id")
    return boxes.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def char_cap(chars: DataFrame, most: int = 9) -> DataFrame:
    """The most confident characters of each crop."""
    order = W.partitionBy("crop_id").orderBy(F.desc_nulls_last("conf"), "char_id")
    return chars.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes a_* and b_*, 0 without a union."""
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col(a + hi), F.col(b + hi)) - F.greatest(F.col(a + lo), F.col(b + lo)))
    area = lambda p: (F.col(p + "x2") - F.col(p + "x1")) * (F.col(p + "y2") - F.col(p + "y1"))
    inter = side("x1", "x2") * side("y1", "y2")
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def iou_pair_join(boxes: DataFrame, truth: DataFrame, least: float = 0.5, **also: str) -> DataFrame:
    """frame_id, det_id, truth_id, iou of the pairs of one frame that overlap enough: an equi join with a filter. ``also``: names for one more column of the boxes, then of the truths."""
    corners = ("x1", "y1", "x2", "y2")
    more = [F.col(c).alias(name) for name, c in also.items()]
    a = boxes.select("frame_id", "det_id", *[F.col(c).alias("a_" + c) for c in corners], *more[:1])
    b = truth.select("frame_id", "truth_id", *[F.col(c).alias("b_" + c) for c in corners], *more[1:])
    return a.join(b, "frame_id").select("frame_id", "det_id", "truth_id", iou("a_", "b_").alias("iou"), *also).where(F.col("iou") >= least)
