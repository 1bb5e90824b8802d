"""Registered jobs over reads and characters: operator, input views, SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import text
from ..operators.text import AS_DIGITS, AS_LETTERS, DIGITS, FORMATS, FORMATS_V1, LETTERS


def _bare(raw: str) -> str:
    return f"regexp_replace(translate(upper({raw}), 'OI', '01'), '[^A-Z0-9.]', '', 'g')"


def _format(clean: str, formats: list[tuple[str, str]], plate: bool) -> str:
    joined = lambda p: "-".join(f"\\{i + 1}" for i in range(p.count("(")))
    said = lambda name, p: f"regexp_replace({clean}, '{p}', '{joined(p)}')" if plate else f"'{name}'"
    return "CASE " + " ".join(f"WHEN regexp_matches({clean}, '{p}') THEN {said(name, p)}" for name, p in formats) + " END"


def _clean(formats: list[tuple[str, str]]) -> str:
    return f"""SELECT event_id, CASE WHEN reason IS NULL THEN p ELSE '' END AS plate, CASE WHEN reason IS NULL THEN f END AS format, reason FROM
 (SELECT *, CASE WHEN raw = '' THEN 'empty' WHEN length(clean) NOT BETWEEN 7 AND 13 THEN 'length' WHEN f = 'foreign' AND p LIKE '%-000' THEN 'serial' WHEN f IS NULL THEN 'format' END AS reason FROM
 (SELECT *, {_format('clean', formats, True)} AS p, {_format('clean', formats, False)} AS f FROM (SELECT event_id, raw, {_bare('raw')} AS clean FROM {{v_reads}} r) a) b) c"""


def _repaired(t: str) -> str:
    digit, letter = (lambda c: f"translate({c}, '{LETTERS}', '{AS_DIGITS}')"), (lambda c: f"translate({c}, '{DIGITS}', '{AS_LETTERS}')")
    one = f"(CASE WHEN i <= 2 THEN {digit('c')} WHEN i = 3 THEN {letter('c')} ELSE c END)"
    two = f"(CASE WHEN length({t}) >= 4 AND i > length({t}) - 4 THEN {digit(one)} ELSE {one} END)"
    three = f"(CASE WHEN length({t}) >= 7 AND i = length({t}) - 6 THEN {letter(two)} ELSE {two} END)"
    return f"CASE WHEN length({t}) < 3 THEN {t} ELSE array_to_string(list_transform(string_split({t}, ''), lambda c, i: {three}), '') END"


_CAPPED = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY conf DESC NULLS LAST, char_id) AS place FROM {v_chars} d) q WHERE place <= 9"


def _assembled(chars: str, last: str, tail: str) -> str:
    """CTEs up to ``far``: characters with their distance from the fitted line; then ``last`` says which are upper, ``tail`` whether they are apart."""
    return f"""WITH chars AS ({chars}),
 fit AS (SELECT crop_id, count(*) AS n, avg(conf) AS mean_conf, var_pop(cx) * count(cx) > 1e-6 AS tilted, CASE WHEN var_pop(cx) * count(cx) > 1e-6 THEN regr_slope(cy, cx) ELSE 0 END AS slope, CASE WHEN var_pop(cx) * count(cx) > 1e-6 THEN regr_intercept(cy, cx) ELSE avg(cy) END AS base, median(h) AS middle, list_sort(list(h))[1 + count(*) // 2] AS tall FROM chars GROUP BY crop_id),
 far AS (SELECT c.*, n, tilted, mean_conf, middle, tall, cy - (slope * cx + base) AS r FROM chars c JOIN fit USING (crop_id)),
 placed AS (SELECT *, row_number() OVER w AS rn, r - lag(r) OVER w AS gap, min(r) OVER (PARTITION BY crop_id) AS lo, max(r) OVER (PARTITION BY crop_id) AS hi FROM far WINDOW w AS (PARTITION BY crop_id ORDER BY r, cx, char_id)),
 widest AS (SELECT crop_id, max(gap) AS widest FROM placed GROUP BY crop_id),
 cut AS (SELECT crop_id, any_value(widest) AS widest, min(rn) - 1 AS k FROM placed JOIN widest USING (crop_id) WHERE gap = widest GROUP BY crop_id),
 sided AS (SELECT p.*, widest, {last} AS up FROM placed p LEFT JOIN cut USING (crop_id)),
 judged AS (SELECT crop_id, count(*) FILTER (up) >= 2 AND count(*) FILTER (NOT up) >= 2 AND max(n) >= 4 AND {tail} AND max(cx) FILTER (up) >= min(cx) FILTER (NOT up) AND max(cx) FILTER (NOT up) >= min(cx) FILTER (up) AS two, avg(cy) FILTER (up) > avg(cy) FILTER (NOT up) AS turned FROM sided GROUP BY crop_id)
 SELECT crop_id, text_of(string_agg(ch, '' ORDER BY CASE WHEN coalesce(two, false) AND up = coalesce(turned, false) THEN 1 ELSE 0 END, cx, char_id)) AS text, round(any_value(mean_conf), 6) AS conf, CAST(CASE WHEN coalesce(any_value(two), false) THEN 2 ELSE 1 END AS BIGINT) AS n_rows FROM sided JOIN judged USING (crop_id) GROUP BY crop_id"""


def _parsed(df: DataFrame) -> DataFrame:
    found = text.parse_vectors(df)
    return found.select("id", F.size("emb").cast("long").alias("n"), F.aggregate("emb", F.lit(0.0), lambda s, x: s + x).alias("total"), "reason")


_ASSEMBLED = _assembled(_CAPPED, "rn <= k", "any_value(widest) >= 0.6::DOUBLE * any_value(middle)")
_MIDRANGE = _assembled("SELECT crop_id, char_id, ch, cx, cy / 100 AS cy, h / 100 AS h, conf FROM {v_chars} d", "r < (lo + hi) / 2", "bool_and(tilted) AND any_value(hi) - any_value(lo) > greatest(0.18::DOUBLE, 0.6::DOUBLE * any_value(tall))").replace("text_of(", "(")

SPECS = {
    "clean_plates": (text.clean_plates, ["v_reads"], _clean(FORMATS)),
    "clean_plates_v1": (text.clean_plates_v1, ["v_reads"], _clean(FORMATS_V1)),
    "repair_plates": (text.repair_plates, ["v_reads"], f"SELECT event_id, text, CAST(len(list_filter(range(1, length(pred) + 1), lambda j: pred[j] <> text[j])) AS BIGINT) AS n_changed FROM (SELECT event_id, pred, {_repaired('pred')} AS text FROM {{v_reads}} r) q"),
    "normalize_text": (text.normalize_text, ["v_reads"], "SELECT event_id, translate(upper(trim(raw)), ' -._', '') AS text FROM {v_reads} r"),
    "assemble_reads": (text.assemble_reads, ["v_chars"], f"SELECT crop_id, {_repaired('t')} AS text, conf, n_rows FROM ({_ASSEMBLED.replace('text_of(', '(').replace(' AS text,', ' AS t,')}) z"),
    "assemble_reads_midrange": (text.assemble_reads_midrange, ["v_chars"], _MIDRANGE),
    "assemble_reads_yrange": (text.assemble_reads_yrange, ["v_chars"], "SELECT crop_id, string_agg(ch, '' ORDER BY line, cx, char_id) AS text, round(avg(conf), 6) AS conf FROM (SELECT *, CASE WHEN hi - lo > 30 AND cy >= (lo + hi) / 2 THEN 1 ELSE 0 END AS line FROM (SELECT *, min(cy) OVER (PARTITION BY crop_id) AS lo, max(cy) OVER (PARTITION BY crop_id) AS hi FROM {v_chars} d) a) b GROUP BY crop_id"),
    "best_variant": (text.best_variant, ["v_variants"], "SELECT crop_id, coalesce(text, '') AS text, coalesce(conf, 0) AS conf FROM (SELECT DISTINCT crop_id FROM {v_variants} a) c LEFT JOIN (SELECT crop_id, text, conf FROM {v_variants} v WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY crop_id ORDER BY conf DESC, variant) = 1) b USING (crop_id)"),
    "ocr_line_merge": (text.ocr_line_merge, ["v_variants"], "SELECT crop_id, upper(replace(string_agg(text, '' ORDER BY variant), ' ', '')) AS text, round(avg(coalesce(score, 0.5::DOUBLE)), 6) AS conf FROM {v_variants} v GROUP BY crop_id"),
    "parse_vectors": (_parsed, ["v_vector_text"], "SELECT id, CASE WHEN reason IS NULL THEN CAST(3 AS BIGINT) END AS n, CASE WHEN reason IS NULL THEN list_sum(v) END AS total, reason FROM (SELECT *, CASE WHEN body = '' THEN 'empty' WHEN len(list_filter(v, lambda x: x IS NULL)) > 0 THEN 'number' WHEN len(v) <> 3 THEN 'size' END AS reason FROM (SELECT *, list_transform(regexp_split_to_array(body, '[,\\s]+'), lambda p: try_cast(p AS DOUBLE)) AS v FROM (SELECT id, trim(regexp_replace(txt, '[\\[\\]]', '', 'g')) AS body FROM {v_vector_text} t) a) b) c"),
    "string_eval": (text.string_eval, ["v_read_conf"], f"SELECT count(*) AS n, count(*) FILTER (base = pred) AS exact_raw, count(*) FILTER (want = got) AS exact_plate, count(got) AS pass_pred, count(want) AS pass_truth, round(avg(conf), 6) AS mean_conf, round(avg(levenshtein(base, pred)), 6) AS mean_dist, round(avg(levenshtein(base, pred) / greatest(length(base), 1)), 6) AS mean_cer FROM (SELECT base, pred, conf, {_format(_bare('base'), FORMATS, True)} AS want, {_format(_bare('pred'), FORMATS, True)} AS got FROM {{v_read_conf}} r) q WHERE want IS NOT NULL"),
    "char_position_diff": (text.char_position_diff, ["v_reads"], f"SELECT * FROM (SELECT event_id, pos, nullif(pred[pos], '') AS seen, nullif(mended[pos], '') AS mended, nullif(base[pos], '') AS truth FROM (SELECT *, unnest(range(1, greatest(length(base), length(pred)) + 1)) AS pos FROM (SELECT event_id, base, pred, {_repaired('pred')} AS mended FROM {{v_reads}} r) a) b) c WHERE mended IS DISTINCT FROM truth"),
    "char_confidence": (text.char_confidence, ["v_read_chars", "v_reads"], f"SELECT event_id, pos, ch AS seen, mended[pos] AS mended, nullif(base[pos], '') AS truth, mended[pos] <> ch AS changed, mended[pos] IS DISTINCT FROM nullif(base[pos], '') AS wrong, conf FROM {{v_read_chars}} c JOIN (SELECT event_id, base, {_repaired('pred')} AS mended FROM {{v_reads}} r WHERE base <> pred) w USING (event_id)"),
    "weakest_chars": (text.weakest_chars, ["v_read_chars", "v_reads"], "SELECT event_id, pos, ch, conf, mean_conf FROM (SELECT event_id, pos, ch, conf, round(avg(conf) OVER (PARTITION BY event_id), 6) AS mean_conf, row_number() OVER (PARTITION BY event_id ORDER BY conf, pos) AS place FROM {v_read_chars} c JOIN (SELECT event_id FROM {v_reads} r WHERE base <> pred) w USING (event_id) WHERE conf IS NOT NULL) q WHERE place = 1"),
}
