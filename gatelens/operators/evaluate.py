"""Evaluation of entry and exit passes: one outcome for each sample, and the reports over outcomes.

A sample has i, entry_raw, entry_faces, gallery, exit_raw, exit_faces, probe. A null read is no plate, a null vector has
no similarity and matches nothing. Similarities have six decimals; ties go to the smaller record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import folder, written
from .identity import cosine, dot, hash_rank
from .percentiles import exact_percentiles
from .text import FORMATS, bare, first_format

THRESHOLD = 0.05


def plate_of(raw: str) -> Column:
    """The canonical plate of a read, null for none. The cleaned read is bound once, as the only element of an array, so the
    rule stays one small call where filters repeat it."""
    canonical = lambda clean: F.when(~clean.rlike("^[0-9]{5}(NN|NG|QT|CV)000$"), first_format(clean, FORMATS)[0])
    return F.get(F.transform(F.array(bare(F.col(raw))), canonical), F.lit(0))


def _passes(samples: DataFrame) -> DataFrame:
    """i, entry_faces, exit_faces, plates, rid (of an enrolled entry), genuine_sim, and the vectors that may be compared with their norms; written once, as every
    evaluation reads it three times."""
    rows = samples.withColumn("plate_entry", plate_of("entry_raw")).withColumn("plate_exit", plate_of("exit_raw"))
    rows = rows.withColumn("rid", F.when(F.col("plate_entry").isNotNull() & (F.col("entry_faces") == 1), F.col("i")))
    leaves = F.col("rid").isNotNull() & (F.col("exit_faces") > 0)
    genuine = F.when(leaves, F.round(cosine("gallery", "probe"), 6)).alias("genuine_sim")
    probe, gallery = F.when(leaves & F.col("plate_exit").isNotNull(), F.col("probe")), F.when(F.col("rid").isNotNull(), F.col("gallery"))
    rows = rows.select("i", "entry_faces", "exit_faces", "plate_entry", "plate_exit", "rid", genuine, probe.alias("probe"), gallery.alias("gallery"))
    rows = rows.withColumn("probe_norm", _norm("probe")).withColumn("gallery_norm", _norm("gallery"))
    return written(rows, f"{folder(samples.sparkSession, 'passes')}/rows")


def _norm(c: str) -> Column:
    return F.sqrt(dot(F.col(c), F.col(c)))


def _candidates(passes: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    asked = passes.where("rid IS NOT NULL AND exit_faces > 0 AND plate_exit IS NOT NULL AND probe IS NOT NULL").select("i", F.col("plate_exit").alias("plate"), "probe", "probe_norm")
    known = passes.where("rid IS NOT NULL AND gallery IS NOT NULL").select(F.col("rid").alias("cand"), F.col("plate_entry").alias("plate"), "gallery", "gallery_norm", F.lit(False).alias("before"))
    if earlier is not None:
        others = earlier.select(F.col("id").alias("cand"), plate_of("raw").alias("plate"), "gallery", _norm("gallery").alias("gallery_norm"), F.lit(True).alias("before"))
        known = known.unionByName(others.where("plate IS NOT NULL AND gallery IS NOT NULL"))
    sim = F.round(dot(F.col("probe"), F.col("gallery")) / (F.col("probe_norm") * F.col("gallery_norm") + F.lit(1e-8)), 6)  # the norms are found once a row, not once a pair
    return asked.join(known, "plate").select("i", "cand", sim.alias("sim"), "before").where("sim IS NOT NULL")


def candidates(samples: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """i, cand, sim: enrolled records of the plate that the exit read gives. earlier: records (id, raw, gallery) from before the samples, with ids of their own."""
    return _candidates(_passes(samples), earlier).select("i", "cand", "sim")


def _outcomes(passes: DataFrame, top: DataFrame, least: float) -> DataFrame:
    """The outcome of each pass, from the best candidates (i, match_sim, matched_rid, before)."""
    rows = passes.drop("probe", "gallery", "probe_norm", "gallery_norm").join(top, "i", "left")
    stage = (
        F.when(F.col("plate_entry").isNull(), "entry_ocr_invalid").when(~F.coalesce(F.col("entry_faces") == 1, F.lit(False)), "entry_face")
        .when(~F.coalesce(F.col("exit_faces") > 0, F.lit(False)), "exit_face_none").when(F.col("plate_exit").isNull(), "exit_ocr_invalid")
        .when(F.col("match_sim").isNull(), "exit_plate_not_found").when(F.col("match_sim") < least, "exit_sim_below_thr").when(F.col("matched_rid") != F.col("rid"), "exit_wrong_id")
    )
    matched = F.coalesce(F.col("match_sim") >= least, F.lit(False))
    rows = rows.withColumn("drop_stage", stage)
    return rows.select("i", "plate_entry", "rid", "match_sim", "matched_rid", "genuine_sim", matched.alias("exit_matched"), F.col("drop_stage").isNull().alias("exit_correct"), "drop_stage", "before")


def _evaluated(samples: DataFrame, least: float = THRESHOLD, earlier: DataFrame | None = None) -> DataFrame:
    passes = _passes(samples)
    top = _candidates(passes, earlier).groupBy("i").agg(F.max(F.struct("sim", (-F.col("cand")).alias("down"), "before")).alias("top"))
    return _outcomes(passes, top.select("i", F.col("top.sim").alias("match_sim"), (-F.col("top.down")).alias("matched_rid"), "top.before"), least)


def paired_eval(samples: DataFrame, least: float = THRESHOLD, earlier: DataFrame | None = None) -> DataFrame:
    """i, plate_entry, rid, match_sim, matched_rid, genuine_sim, exit_matched, exit_correct, drop_stage: the first stage that fails, null for full success."""
    return _evaluated(samples, least, earlier).drop("before")


def pipeline_funnel(outcomes: DataFrame) -> DataFrame:
    """stage, n, pct of all samples."""
    passed = {"entry_ocr_valid": "plate_entry IS NOT NULL", "entry_ok": "rid IS NOT NULL", "exit_face_ok": "genuine_sim IS NOT NULL", "exit_matched": "exit_matched", "exit_correct": "exit_correct", "exit_wrong": "exit_matched AND NOT exit_correct"}
    counts = outcomes.agg(F.count("*").alias("all_n"), *[F.count_if(F.expr(c)).alias(s) for s, c in passed.items()])
    rows = counts.select("all_n", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in passed])).alias("r"))
    return rows.select("r.stage", "r.n", F.round(100 * F.col("r.n") / F.greatest("all_n", F.lit(1)), 4).alias("pct"))


def drop_reasons(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("drop_stage IS NOT NULL").groupBy("drop_stage").agg(F.count("*").alias("n"))


def drop_details(outcomes: DataFrame, most: int = 40) -> DataFrame:
    """The first rows of each drop stage."""
    order = W.partitionBy("drop_stage").orderBy("i")
    return outcomes.where("drop_stage IS NOT NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("drop_stage", "i", "plate_entry", "match_sim")


def below_thr_profile(outcomes: DataFrame) -> DataFrame:
    """One row over matches below the threshold: n, low, p25, median, p75, high, n_same (the record was the right one)."""
    low = outcomes.where("drop_stage = 'exit_sim_below_thr'").select("match_sim", "rid", "matched_rid")
    low = written(low, f"{folder(outcomes.sparkSession, 'below')}/rows")  # each round of the percentiles reads it
    one = low.agg(F.count("*").alias("n"), F.min("match_sim").alias("low"), F.max("match_sim").alias("high"), F.count_if(F.col("rid") == F.col("matched_rid")).alias("n_same"))
    exact = exact_percentiles(low, F.lit(1), F.col("match_sim"), [0.25, 0.5, 0.75])
    cut = [F.round(F.get("cuts", F.lit(i)), 6).alias(name) for i, name in enumerate(("p25", "median", "p75"))]
    return one.join(F.broadcast(exact.select("cuts")), how="left").select("n", "low", *cut, "high", "n_same")  # one row each


def threshold_whatif(outcomes: DataFrame, hundredths: tuple[int, ...] = (0, 2, 5, 10, 15, 20)) -> DataFrame:
    """thr (hundredths), correct, wrong if the threshold were that; thresholds are exploded after rows are counted by similarity."""
    step = F.floor(F.round(F.col("match_sim") * 100, 4))
    counts = outcomes.where("match_sim IS NOT NULL").groupBy(step.alias("step"), (F.col("rid") == F.col("matched_rid")).alias("same")).count()
    rows = counts.select("*", F.explode(F.array(*map(F.lit, hundredths))).alias("thr"))
    n = lambda same: F.coalesce(F.sum(F.when((F.col("step") >= F.col("thr")) & (F.col("same") == same), F.col("count"))), F.lit(0))
    return rows.groupBy("thr").agg(n(True).alias("correct"), n(False).alias("wrong"))


def wrong_match_report(samples: DataFrame, most: int = 3) -> DataFrame:
    """i, rank, cand, sim, gap (over the genuine similarity) of the best candidates of wrong matches."""
    passes = _passes(samples)
    order = W.partitionBy("i").orderBy(F.desc("sim"), "cand")
    ranked = _candidates(passes).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= max(most, 1))
    ranked = written(ranked, f"{folder(samples.sparkSession, 'ranked')}/rows")
    top = ranked.where("rank = 1").select("i", F.col("sim").alias("match_sim"), F.col("cand").alias("matched_rid"), "before")
    wrong = _outcomes(passes, top, THRESHOLD).where("drop_stage = 'exit_wrong_id'").select("i", "genuine_sim")
    return ranked.where(F.col("rank") <= most).join(wrong, "i").select("i", "rank", "cand", "sim", F.round(F.col("sim") - F.col("genuine_sim"), 6).alias("gap"))


def wrong_match_origin(samples: DataFrame, earlier: DataFrame) -> DataFrame:
    """i, match_sim, matched_rid, genuine_sim, gap (over the genuine similarity), origin of wrong matches where the gate knew ``earlier`` records (id, raw, gallery)
    too: 'earlier' or 'own', as the record that won is from before the samples or of one of them. Ids of both must differ."""
    wrong = _evaluated(samples, earlier=earlier).where("drop_stage = 'exit_wrong_id'")
    gap = F.round(F.col("match_sim") - F.col("genuine_sim"), 6).alias("gap")
    return wrong.select("i", "match_sim", "matched_rid", "genuine_sim", gap, F.when(F.col("before"), "earlier").otherwise("own").alias("origin"))


def wrong_match_counts(samples: DataFrame, earlier: DataFrame) -> DataFrame:
    """One row: n wrong matches, by_earlier and by_own records, covered (the winner is nearer than the genuine record)."""
    n = lambda c: F.count_if(F.expr(c))
    return wrong_match_origin(samples, earlier).agg(F.count("*").alias("n"), n("origin = 'earlier'").alias("by_earlier"), n("origin = 'own'").alias("by_own"), n("gap > 0").alias("covered"))


def index_pairing(left: DataFrame, right: DataFrame, seed: int = 5) -> DataFrame:
    """a, b: two tables' ids in md5 order, paired by place up to the shorter one."""
    a, b = hash_rank(left, seed), hash_rank(right, seed)
    return a.select("at", F.col("id").alias("a")).join(b.select("at", F.col("id").alias("b")), "at").select("a", "b")


def db_scaling_summary(timing: DataFrame) -> DataFrame:
    """n, total_ms, per_ms of inserts and search_ms (mean) for each table size."""
    total = F.sum(F.when(F.col("op") == "insert", F.col("ms")))
    return timing.groupBy("n").agg(F.round(total, 4).alias("total_ms"), F.round(total / F.col("n"), 6).alias("per_ms"), F.round(F.avg(F.when(F.col("op") == "search", F.col("ms"))), 6).alias("search_ms"))
