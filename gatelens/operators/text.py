"""Jobs over plate reads and character boxes: cleaning, repair, assembly of characters, comparison of strings.

All rules are column expressions. A null or empty read gives an empty plate with the reason ``empty``; equal confidences go to the
lower number. What is collected is bounded by the characters of one crop."""

from __future__ import annotations

from math import fma

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .boxes import char_cap

# Plate formats in the order in which they are tried (name, pattern); a hyphen joins the groups.
FORMATS = [
    ("series_dot", r"^([0-9]{2}[A-Z][0-9])([0-9]{3}\.[0-9]{2})$"),
    ("letter_dot", r"^([0-9]{2}[A-Z])([0-9]{3}\.[0-9]{2})$"),
    ("letters_dot", r"^([0-9]{2}[A-Z]{2})([0-9]{3}\.[0-9]{2})$"),
    ("foreign", r"^([0-9]{2})([0-9]{3})(NN|NG|QT|CV)([0-9]{3})$"),
    ("letter", r"^([0-9]{2}[A-Z])([0-9]{4,5})$"),
    ("series", r"^([0-9]{2}[A-Z][0-9])([0-9]{4,5})$"),
    ("letters", r"^([0-9]{2}[A-Z]{2})([0-9]{4,5})$"),
]
# The formats of the older rules.
FORMATS_V1 = [
    ("series_dot", r"^([0-9]{2}[A-Z][0-9]{1,2})([0-9]{3,5}\.[0-9]{1,2})$"),
    ("letter", r"^([0-9]{2}[A-Z])([0-9]{5})$"),
    ("series", r"^([0-9]{2}[A-Z][0-9])([0-9]{4,5})$"),
    ("series_two", r"^([0-9]{2}[A-Z][0-9]{2})([0-9]{3,4})$"),
]
# Letters read for digits, and digits read for letters.
LETTERS, AS_DIGITS = "DOQILTZASGB", "00011124568"
DIGITS, AS_LETTERS = "012456789", "DIZASGTBG"


def bare(raw: Column) -> Column:
    """Upper case, O and I as digits, nothing but letters, digits and dots."""
    return F.regexp_replace(F.translate(F.upper(raw), "OI", "01"), "[^A-Z0-9.]", "")


def first_format(clean: Column, formats: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Canonical plate and name of the first format that matches; both null if none does."""
    plate, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, pattern in reversed(formats):
        groups = pattern.count("(")
        hit = clean.rlike(pattern)
        plate = F.when(hit, F.regexp_replace(clean, pattern, "-".join(f"${i + 1}" for i in range(groups)))).otherwise(plate)
        name = F.when(hit, F.lit(label)).otherwise(name)
    return plate, name


def clean_plates(reads: DataFrame, formats: list[tuple[str, str]] = FORMATS) -> DataFrame:
    """event_id, plate ('' if refused), format, reason (empty, length, serial, format or null)."""
    rows = reads.select("event_id", "raw", bare(F.col("raw")).alias("clean"))
    plate, name = first_format(F.col("clean"), formats)
    rows = rows.withColumn("p", plate).withColumn("f", name)
    reason = (
        F.when(F.coalesce(F.col("raw"), F.lit("")) == "", "empty")
        .when(~F.length("clean").between(7, 13), "length")
        .when((F.col("f") == "foreign") & F.col("p").endswith("-000"), "serial")
        .when(F.col("f").isNull(), "format")
    )
    rows = rows.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return rows.select("event_id", F.when(ok, F.col("p")).otherwise("").alias("plate"), F.when(ok, F.col("f")).alias("format"), "reason")


def clean_plates_v1(reads: DataFrame) -> DataFrame:
    """The same with the older formats."""
    return clean_plates(reads, FORMATS_V1)


def repaired(text: Column) -> Column:
    """Characters brought to what their place expects: digits at the first two and the last four places, a letter at the third
    and at the seventh from the end, in that order; texts under three characters stay."""
    n = F.length(text)
    digit = lambda c: F.translate(c, LETTERS, AS_DIGITS)
    letter = lambda c: F.translate(c, DIGITS, AS_LETTERS)

    def fix(c: Column, i: Column) -> Column:
        c = F.when(i < 2, digit(c)).when(i == 2, letter(c)).otherwise(c)
        c = F.when((n >= 4) & (i >= n - 4), digit(c)).otherwise(c)
        return F.when((n >= 7) & (i == n - 7), letter(c)).otherwise(c)

    return F.when(n < 3, text).otherwise(F.array_join(F.transform(F.split(text, ""), fix), ""))


def repair_plates(reads: DataFrame) -> DataFrame:
    """event_id, text, n_changed."""
    rows = reads.select("event_id", "pred", repaired(F.col("pred")).alias("text"))
    changed = F.size(F.filter(F.arrays_zip(F.split("pred", "").alias("a"), F.split("text", "").alias("b")), lambda p: p.a != p.b))
    return rows.select("event_id", "text", changed.cast("long").alias("n_changed"))


def normalize_text(reads: DataFrame) -> DataFrame:
    """event_id, text: trimmed, upper case, without blanks, hyphens, dots and underscores; null becomes empty."""
    return reads.select("event_id", F.translate(F.upper(F.trim(F.coalesce("raw", F.lit("")))), " -._", "").alias("text"))


def _joined(chars: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.transform(chars, lambda c: F.struct(c.cx, c.char_id, c.ch))), lambda c: c.ch), "")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def fused(a: float, b: float, c: float) -> float:
    """a * b + c rounded once."""
    try:
        return fma(a, b, c)
    except (ValueError, OverflowError):  # infinite places
        return a * b + c


def fitted(xs: list[float], ys: list[float]) -> tuple[float, float, bool]:
    """Slope and base of the line through the places in their order, and whether it is tilted; else the base is their mean. Products are added
    with one rounding, as the SQL's engine does, so characters at equal distances from the line fall on the same side there."""
    n, mx, my, xy, xx, sx, sy = 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    for x, y in zip(xs, ys):
        n += 1
        dx = x - mx
        mx += dx / n
        my += (y - my) / n
        xy = fused(dx, y - my, xy)
        xx += (x - mx) * dx
        sx, sy = sx + x, sy + y
    if not xx / n * n > 1e-6:
        return 0.0, sy / n, False
    slope = xy / n / (xx / n)
    return slope, fused(-slope, sx / n, sy / n), True


def _fit(chars: Column) -> Column:
    """slope, base, tilted (``fitted``) of an array of cx, cy."""

    def fit(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fitted(x.tolist(), y.tolist()) for x, y in zip(xs, ys)], columns=["slope", "base", "tilted"])

    return F.pandas_udf(fit, "slope double, base double, tilted boolean")(F.transform(chars, lambda c: c.cx), F.transform(chars, lambda c: c.cy))


def _rows(chars: DataFrame, falling: bool = False) -> DataFrame:
    """One row a crop: figures of the line through its characters, in the order of their numbers (falling: of falling confidence), and the characters with their
    distance from it."""
    first = F.coalesce(-F.col("conf"), F.lit(float("inf"))) if falling else F.lit(0.0)
    char = F.struct(first.alias("first"), "char_id", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"), "ch")
    line = chars.where("cx IS NOT NULL AND cy IS NOT NULL").groupBy("crop_id").agg(
        F.count("*").cast("int").alias("n"), F.avg("conf").alias("mean_conf"), F.array_sort(F.collect_list(char)).alias("chars"), F.sort_array(F.collect_list(F.when(F.col("h") > 0, F.col("h")))).alias("heights"))
    line = line.withColumn("fit", _fit(F.col("chars"))).select("*", "fit.slope", "fit.base", "fit.tilted")
    far = F.transform("chars", lambda c: F.struct((c.cy - (F.col("slope") * c.cx + F.col("base"))).alias("r"), c.cx.alias("cx"), c.char_id.alias("char_id"), c.cy.alias("cy"), c.ch.alias("ch")))
    return line.withColumn("far", F.array_sort(far))


def _two_rows(crops: DataFrame, apart: Column) -> DataFrame:
    """Reads ``upper`` then ``lower`` where they are apart, have two characters each and lie over each other; else all in x order."""
    xs = lambda part: F.transform(part, lambda c: c.cx)
    over = (F.array_max(xs(F.col("upper"))) >= F.array_min(xs(F.col("lower")))) & (F.array_max(xs(F.col("lower"))) >= F.array_min(xs(F.col("upper"))))
    two = F.coalesce((F.col("n") >= 4) & apart & (F.size("upper") >= 2) & (F.size("lower") >= 2) & over, F.lit(False))
    ys = lambda part: _mean(F.transform(part, lambda c: c.cy))
    text = F.when(ys(F.col("upper")) > ys(F.col("lower")), F.concat(_joined(F.col("lower")), _joined(F.col("upper")))).otherwise(F.concat(_joined(F.col("upper")), _joined(F.col("lower"))))
    crops = crops.withColumn("two", two).withColumn("text", F.when(F.col("two"), text).otherwise(_joined(F.col("far"))))
    return crops.select("crop_id", "text", F.round("mean_conf", 6).alias("conf"), F.when(F.col("two"), 2).otherwise(1).cast("long").alias("n_rows"))


def assemble_reads(chars: DataFrame, most: int = 9, image_height: float = 100.0) -> DataFrame:
    """crop_id, text, conf, n_rows: the most confident characters, split at the widest gap between distances from their
    fitted line if it is 0.6 of a median character or more, in reading order, repaired. One shuffle by crop."""
    crops = _rows(char_cap(chars, most), falling=True)
    middle = F.when(F.size("heights") > 0, (F.element_at("heights", F.floor((F.size("heights") + 1) / 2).cast("int")) + F.element_at("heights", F.floor(F.size("heights") / 2 + 1).cast("int"))) / 2).otherwise(image_height * 0.2)
    gaps = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.get("far", i).r - F.get("far", i - 1).r)
    crops = crops.withColumn("middle", middle).withColumn("gaps", F.when(F.col("n") >= 4, gaps)).withColumn("widest", F.array_max("gaps"))
    cut = F.coalesce(F.array_position("gaps", F.col("widest")).cast("int"), F.col("n"))
    crops = crops.withColumn("cut", cut).withColumn("upper", F.slice("far", F.lit(1), F.col("cut"))).withColumn("lower", F.slice("far", F.col("cut") + 1, F.col("n")))
    return _two_rows(crops, F.col("widest") >= 0.6 * F.col("middle")).withColumn("text", repaired(F.col("text")))


def assemble_reads_midrange(chars: DataFrame, height: float = 100.0, gap: float = 0.18) -> DataFrame:
    """The same split at the middle of the distances where their range is over ``gap`` and 0.6 of the upper median character,
    in parts of the crop's height; all characters, no repair."""
    crops = _rows(chars.withColumn("cy", F.col("cy") / height).withColumn("h", F.col("h") / height))
    crops = crops.withColumn("lo", F.get("far", F.lit(0)).r).withColumn("hi", F.get("far", F.col("n") - 1).r).withColumn("mid", (F.col("lo") + F.col("hi")) / 2)
    tall = F.when(F.size("heights") > 0, F.get("heights", F.floor(F.size("heights") / 2).cast("int"))).otherwise(0.2)
    crops = crops.withColumn("upper", F.filter("far", lambda c: c.r < F.col("mid"))).withColumn("lower", F.filter("far", lambda c: c.r >= F.col("mid")))
    return _two_rows(crops, F.col("tilted") & (F.col("hi") - F.col("lo") > F.greatest(F.lit(gap), 0.6 * tall)))


def assemble_reads_yrange(chars: DataFrame, height: float = 100.0) -> DataFrame:
    """crop_id, text, conf: two rows where the characters' y range is over 0.3 of the height, cut at half its way."""
    span = chars.withColumn("lo", F.min("cy").over(W.partitionBy("crop_id"))).withColumn("hi", F.max("cy").over(W.partitionBy("crop_id")))
    row = F.when((F.col("hi") - F.col("lo") > 0.3 * height) & (F.col("cy") >= (F.col("lo") + F.col("hi")) / 2), 1).otherwise(0)
    crops = span.groupBy("crop_id").agg(F.array_sort(F.collect_list(F.struct(row.alias("row"), "cx", "char_id", "ch"))).alias("chars"), F.avg("conf").alias("conf"))
    return crops.select("crop_id", F.array_join(F.transform("chars", lambda c: c.ch), "").alias("text"), F.round("conf", 6).alias("conf"))


def best_variant(variants: DataFrame) -> DataFrame:
    """crop_id, text, conf of the most confident read that isn't empty, the first on ties; '' and 0 when there is none."""
    held = F.when(F.col("text") != "", F.struct((-F.col("conf")).alias("c"), "variant", "text", "conf"))
    best = variants.groupBy("crop_id").agg(F.min(held).alias("best"))
    return best.select("crop_id", F.coalesce("best.text", F.lit("")).alias("text"), F.coalesce("best.conf", F.lit(0.0)).alias("conf"))


def ocr_line_merge(lines: DataFrame) -> DataFrame:
    """crop_id, text (lines in order, no blanks, upper case), conf (mean, 0.5 for a missing score)."""
    merged = lines.groupBy("crop_id").agg(F.array_sort(F.collect_list(F.struct("variant", F.coalesce("text", F.lit("")).alias("text")))).alias("t"), F.avg(F.coalesce("score", F.lit(0.5))).alias("c"))
    return merged.select("crop_id", F.upper(F.replace(F.array_join(F.transform("t", lambda x: x.text), ""), F.lit(" "), F.lit(""))).alias("text"), F.round("c", 6).alias("conf"))


def parse_vectors(rows: DataFrame, dim: int = 3) -> DataFrame:
    """id, emb (null if refused), reason (empty, number, size or null) for '[a, b]' or blank-separated text."""
    inner = F.trim(F.regexp_replace(F.coalesce("txt", F.lit("")), r"[\[\]]", ""))
    parts = F.split(inner, r"[,\s]+")
    emb = F.transform(parts, lambda p: p.try_cast("double"))
    reason = F.when(F.col("inner") == "", "empty").when(F.exists("v", lambda x: x.isNull()), "number").when(F.size("v") != dim, "size")
    parsed = rows.select("id", inner.alias("inner"), emb.alias("v")).withColumn("reason", reason)
    return parsed.select("id", F.when(F.col("reason").isNull(), F.col("v")).alias("emb"), "reason")


def string_eval(reads: DataFrame) -> DataFrame:
    """One row over the reads whose true text is a plate: n, exact_raw, exact_plate, pass_pred, pass_truth, mean_dist, mean_cer, mean_conf (of the
    reads that have a ``conf``; null if none has)."""
    plate = lambda c: F.when(~bare(F.col(c)).rlike("^[0-9]{5}(NN|NG|QT|CV)000$"), first_format(bare(F.col(c)), FORMATS)[0])
    conf = F.col("conf") if "conf" in reads.columns else F.lit(None).cast("double")
    rows = reads.select("base", "pred", conf.alias("conf"), plate("base").alias("want"), plate("pred").alias("got")).where("want IS NOT NULL")
    dist = F.levenshtein("base", "pred")
    r = lambda c: F.round(F.avg(c), 6)
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("base") == F.col("pred")).alias("exact_raw"),
        F.count_if(F.col("want") == F.col("got")).alias("exact_plate"),
        F.count_if(F.col("got").isNotNull()).alias("pass_pred"),
        F.count("want").alias("pass_truth"),
        r(dist).alias("mean_dist"),
        r(dist / F.greatest(F.length("base"), F.lit(1))).alias("mean_cer"),
        r("conf").alias("mean_conf"),
    )


def wrong_reads(chars: DataFrame, reads: DataFrame) -> DataFrame:
    """event_id, truth (text), chars (array of pos, ch, conf in reading order) of the reads whose characters don't spell the true text. One shuffle
    by event_id; an array holds the characters of one read. Characters without a place or a letter are left out, equal places go
    by letter; a read without characters or without a true text has no row; a repeated event_id of ``reads`` has a row for each."""
    spelt = chars.where("pos IS NOT NULL AND ch IS NOT NULL").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ch", "conf"))).alias("chars"))
    text = F.array_join(F.transform("chars", lambda c: c.ch), "")
    rows = spelt.join(reads.where("base IS NOT NULL").select("event_id", F.col("base").alias("truth")), "event_id")
    return rows.withColumn("text", text).where("text <> truth")


def char_confidence(chars: DataFrame, reads: DataFrame) -> DataFrame:
    """event_id, pos (from 1), seen, mended, truth (null beyond its end), changed (by the repair), wrong (after it), conf for every
    character of the reads that aren't right."""
    rows = wrong_reads(chars, reads).withColumn("mended", F.split(repaired(F.col("text")), ""))
    rows = rows.select("event_id", "mended", F.split("truth", "").alias("truth"), F.posexplode("chars").alias("at", "c"))
    rows = rows.select("event_id", (F.col("at") + 1).cast("long").alias("pos"), F.col("c.ch").alias("seen"), F.get("mended", "at").alias("mended"), F.get("truth", "at").alias("truth"), F.col("c.conf").alias("conf"))
    return rows.select("event_id", "pos", "seen", "mended", "truth", (F.col("mended") != F.col("seen")).alias("changed"), (~F.col("mended").eqNullSafe(F.col("truth"))).alias("wrong"), "conf")


def weakest_chars(chars: DataFrame, reads: DataFrame) -> DataFrame:
    """event_id, pos, ch, conf of the least confident character of every read that isn't right, the first on ties, and mean_conf over all of its
    characters; characters without a confidence don't count, and where none has one there is no row."""
    known = F.filter("chars", lambda c: c.conf.isNotNull())
    rows = wrong_reads(chars, reads).withColumn("known", known).where("size(known) > 0")
    # a fold with a strict comparison keeps the first of equals
    least = F.aggregate("known", F.get("known", F.lit(0)), lambda low, c: F.when(c.conf < low.conf, c).otherwise(low))
    rows = rows.withColumn("least", least).withColumn("mean_conf", F.round(_mean(F.transform("known", lambda c: c.conf)), 6))
    return rows.select("event_id", "least.pos", "least.ch", "least.conf", "mean_conf")


def char_position_diff(reads: DataFrame) -> DataFrame:
    """event_id, pos (from 1), seen, mended, truth for every place where the mended character isn't the true one."""
    cut = lambda c: F.split(c, "")
    zipped = F.arrays_zip(cut("pred").alias("seen"), cut(repaired(F.col("pred"))).alias("mended"), cut("base").alias("truth"))
    rows = reads.select("event_id", F.posexplode(zipped).alias("pos", "c"))
    return rows.where("NOT (c.mended <=> c.truth)").select("event_id", (F.col("pos") + 1).cast("long").alias("pos"), "c.seen", "c.mended", "c.truth")
