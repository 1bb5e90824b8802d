"""Registered evaluation and listing jobs: operator, input views, SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, gates, identity, settlement
from ..operators.text import FORMATS
from ..sources import files
from .text import _bare, _format

_DOT = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[])"


def _cosine(a: str, b: str) -> str:
    return f"round({_DOT.format(a, b)} / (sqrt({_DOT.format(a, a)}) * sqrt({_DOT.format(b, b)}) + 1e-8), 6)"


def _plate(c: str) -> str:
    return f"CASE WHEN NOT regexp_matches({_bare(c)}, '^[0-9]{{5}}(NN|NG|QT|CV)000$') THEN {_format(_bare(c), FORMATS, True)} END"


_PASSES = f"(SELECT *, CASE WHEN plate_entry IS NOT NULL AND entry_faces = 1 THEN i END AS rid FROM (SELECT *, {_plate('entry_raw')} AS plate_entry, {_plate('exit_raw')} AS plate_exit FROM {{v_samples}} s) p)"
_CANDIDATES = f"(SELECT x.i, a.rid AS cand, {_cosine('x.probe', 'a.gallery')} AS sim FROM {_PASSES} x JOIN {_PASSES} a ON a.plate_entry = x.plate_exit WHERE x.rid IS NOT NULL AND a.rid IS NOT NULL AND x.exit_faces > 0)"
_OUTCOMES = f"""(SELECT i, plate_entry, rid, match_sim, matched_rid, genuine_sim, coalesce(match_sim >= 0.05, false) AS exit_matched, drop_stage IS NULL AS exit_correct, drop_stage FROM (SELECT p.*, match_sim, matched_rid, CASE WHEN rid IS NOT NULL AND exit_faces > 0 THEN {_cosine('gallery', 'probe')} END AS genuine_sim,
 CASE WHEN plate_entry IS NULL THEN 'entry_ocr_invalid' WHEN entry_faces <> 1 THEN 'entry_face' WHEN exit_faces = 0 THEN 'exit_face_none' WHEN plate_exit IS NULL THEN 'exit_ocr_invalid' WHEN match_sim IS NULL THEN 'exit_plate_not_found' WHEN match_sim < 0.05 THEN 'exit_sim_below_thr' WHEN matched_rid <> rid THEN 'exit_wrong_id' END AS drop_stage
 FROM {_PASSES} p LEFT JOIN (SELECT i, sim AS match_sim, cand AS matched_rid FROM {_CANDIDATES} c QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, cand) = 1) t USING (i)) o)"""
#: The same with the records of v_earlier among the candidates.
_KNOWN = f"(SELECT rid, plate_entry, gallery FROM {_PASSES} y WHERE rid IS NOT NULL UNION ALL SELECT id, {_plate('raw')}, gallery FROM {{v_earlier}} e)"
_WITH_EARLIER = f"(SELECT x.i, a.rid AS cand, {_cosine('x.probe', 'a.gallery')} AS sim FROM {_PASSES} x JOIN {_KNOWN} a ON a.plate_entry = x.plate_exit WHERE x.rid IS NOT NULL AND x.exit_faces > 0)"
_ORIGIN = f"(SELECT i, match_sim, matched_rid, genuine_sim, round(match_sim - genuine_sim, 6) AS gap, CASE WHEN matched_rid < 0 THEN 'earlier' ELSE 'own' END AS origin FROM {_OUTCOMES.replace(_CANDIDATES, _WITH_EARLIER)} q WHERE drop_stage = 'exit_wrong_id')"
_STAGES = {"entry_ocr_valid": "plate_entry IS NOT NULL", "entry_ok": "rid IS NOT NULL", "exit_face_ok": "genuine_sim IS NOT NULL", "exit_matched": "exit_matched", "exit_correct": "exit_correct", "exit_wrong": "exit_matched AND NOT exit_correct"}
_RANKED = "(SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':5'), id) AS place FROM {0} v)"

#: A walk over the exits of each lot and plate in their order, with the number of the record that is next.
_SETTLED = f"""SELECT id, lot, plate, active_id, outcome, sim, CASE WHEN outcome = 'matched' THEN entry_ts END AS entry_ts, CASE WHEN outcome = 'matched' THEN ts END AS exit_ts,
 CASE WHEN outcome = 'matched' THEN CAST((epoch_us(ts) - epoch_us(entry_ts)) // 60000000 AS BIGINT) END AS duration_min, CASE WHEN outcome = 'matched' THEN sim END AS match_conf FROM
 (WITH RECURSIVE x AS (SELECT *, row_number() OVER (PARTITION BY lot, plate ORDER BY ts, id) AS n FROM {{v_leaving}} l),
  r AS (SELECT *, row_number() OVER (PARTITION BY lot, plate ORDER BY entry_ts, id) AS turn FROM {{v_parked}} k),
  w AS (SELECT DISTINCT lot, plate, 0::BIGINT AS n, 1::BIGINT AS head, NULL::BIGINT AS id, NULL::TIMESTAMP AS ts, NULL::BIGINT AS active_id, NULL::TIMESTAMP AS entry_ts, NULL::DOUBLE AS sim FROM x WHERE plate IS NOT NULL
   UNION ALL SELECT w.lot, w.plate, x.n, w.head + CASE WHEN {_cosine('x.embedding', 'r.embedding')} >= 0.05 THEN 1 ELSE 0 END, x.id, x.ts, r.id, r.entry_ts, {_cosine('x.embedding', 'r.embedding')}
   FROM w JOIN x ON x.lot = w.lot AND x.plate = w.plate AND x.n = w.n + 1 LEFT JOIN r ON r.lot = w.lot AND r.plate = w.plate AND r.turn = w.head AND r.entry_ts <= x.ts)
  SELECT *, CASE WHEN active_id IS NULL THEN 'not_found' WHEN sim >= 0.05 THEN 'matched' ELSE 'mismatch' END AS outcome FROM (SELECT lot, plate, id, ts, active_id, entry_ts, sim FROM w WHERE n > 0
   UNION ALL SELECT lot, plate, id, ts, NULL, NULL, NULL FROM x WHERE plate IS NULL) s) q"""


def _over(report):
    return lambda samples: report(evaluate.paired_eval(samples))


def _avg_digest(faces: DataFrame) -> DataFrame:
    return digest(identity.embedding_avg(faces))


def digest(averages: DataFrame) -> DataFrame:
    """The outer components as whole hundred-thousandths, so that no engine's negative zero matters, and the sum of all by place."""
    whole = lambda x: F.round(x * 100_000).cast("long")
    at = lambda i: whole(F.get("avg", F.lit(i)))
    places = F.aggregate(F.transform("avg", lambda x, i: whole(x) * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return averages.select("image_id", "lane", at(0).alias("first"), at(63).alias("last"), places.alias("places"))


AVG = """SELECT image_id, lane, CAST(round(s[1] / sqrt(list_inner_product(s, s)) * 100000) AS BIGINT) AS first, CAST(round(s[64] / sqrt(list_inner_product(s, s)) * 100000) AS BIGINT) AS last,
 CAST(list_sum(list_transform(range(1, 65), lambda i: i * CAST(round(s[i] / sqrt(list_inner_product(s, s)) * 100000) AS BIGINT))) AS BIGINT) AS places FROM
 (SELECT image_id, lane, list_transform(range(1, 65), lambda i: q * e[i] + coalesce(q1 * e1[i], 0) + coalesce(q2 * e2[i], 0)) AS s FROM
 (SELECT image_id, lane, q, e, lag(q) OVER w AS q1, lag(e) OVER w AS e1, lag(q, 2) OVER w AS q2, lag(e, 2) OVER w AS e2 FROM (SELECT *, greatest(quality, 0.01::DOUBLE) AS q, embedding::DOUBLE[] AS e FROM {v_face_vectors} f WHERE quality IS NOT NULL) a WINDOW w AS (PARTITION BY lane ORDER BY ts, image_id)) b) c"""


def specs(accepted: str, sessions: str) -> dict:
    """The specs, over the SQL of accepted events and of sessions."""
    return {
        "paired_eval": (evaluate.paired_eval, ["v_samples"], f"SELECT * FROM {_OUTCOMES} q"),
        "pipeline_funnel": (_over(evaluate.pipeline_funnel), ["v_samples"], " UNION ALL ".join(f"SELECT '{s}' AS stage, count(*) FILTER ({c}) AS n, round(100.0::DOUBLE * count(*) FILTER ({c}) / greatest(count(*), 1), 4) AS pct FROM {_OUTCOMES} q" for s, c in _STAGES.items())),
        "drop_reasons": (_over(evaluate.drop_reasons), ["v_samples"], f"SELECT drop_stage, count(*) AS n FROM {_OUTCOMES} q WHERE drop_stage IS NOT NULL GROUP BY 1"),
        "drop_details": (_over(evaluate.drop_details), ["v_samples"], f"SELECT drop_stage, i, plate_entry, match_sim FROM {_OUTCOMES} q WHERE drop_stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY drop_stage ORDER BY i) <= 40"),
        "below_thr_profile": (_over(evaluate.below_thr_profile), ["v_samples"], f"SELECT count(*) AS n, min(match_sim) AS low, round(quantile_cont(match_sim, 0.25), 6) AS p25, round(quantile_cont(match_sim, 0.5), 6) AS median, round(quantile_cont(match_sim, 0.75), 6) AS p75, max(match_sim) AS high, count(*) FILTER (rid = matched_rid) AS n_same FROM {_OUTCOMES} q WHERE drop_stage = 'exit_sim_below_thr'"),
        "threshold_whatif": (_over(evaluate.threshold_whatif), ["v_samples"], f"SELECT thr, count(*) FILTER (floor(round(match_sim * 100, 4)) >= thr AND rid = matched_rid) AS correct, count(*) FILTER (floor(round(match_sim * 100, 4)) >= thr AND rid <> matched_rid) AS wrong FROM {_OUTCOMES} q, (SELECT unnest([0, 2, 5, 10, 15, 20]) AS thr) t WHERE match_sim IS NOT NULL GROUP BY thr"),
        "wrong_match_report": (evaluate.wrong_match_report, ["v_samples"], f"SELECT c.i, rank, cand, sim, round(sim - genuine_sim, 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, cand) AS rank FROM {_CANDIDATES} k) c JOIN {_OUTCOMES} o USING (i) WHERE drop_stage = 'exit_wrong_id' AND rank <= 3"),
        "wrong_match_origin": (evaluate.wrong_match_origin, ["v_samples", "v_earlier"], f"SELECT * FROM {_ORIGIN} w"),
        "wrong_match_counts": (evaluate.wrong_match_counts, ["v_samples", "v_earlier"], f"SELECT count(*) AS n, count(*) FILTER (origin = 'earlier') AS by_earlier, count(*) FILTER (origin = 'own') AS by_own, count(*) FILTER (gap > 0) AS covered FROM {_ORIGIN} w"),
        "index_pairing": (evaluate.index_pairing, ["v_exit", "v_active"], f"SELECT x.id AS a, y.id AS b FROM {_RANKED.format('{v_exit}')} x JOIN {_RANKED.format('{v_active}')} y USING (place)"),
        "db_scaling_summary": (evaluate.db_scaling_summary, ["v_scaling"], "SELECT n, round(sum(ms) FILTER (op = 'insert'), 4) AS total_ms, round(sum(ms) FILTER (op = 'insert') / n, 6) AS per_ms, round(avg(ms) FILTER (op = 'search'), 6) AS search_ms FROM {v_scaling} s GROUP BY n"),
        "orientation_pick": (identity.orientation_pick, ["v_rotations"], "SELECT image, code FROM {v_rotations} r WHERE n_faces > 0 QUALIFY row_number() OVER (PARTITION BY image ORDER BY list_position([0, 1, 3, 2], code)) = 1"),
        "embedding_avg": (_avg_digest, ["v_face_vectors"], AVG),
        "exit_settlement": (settlement.exit_settlement, ["v_leaving", "v_parked"], _SETTLED),
        "exit_remaining": (settlement.still_active, ["v_leaving", "v_parked"], f"SELECT id, lot, plate, entry_ts FROM {{v_parked}} k WHERE id NOT IN (SELECT active_id FROM ({_SETTLED}) t WHERE outcome = 'matched')"),
        "event_feed": (gates.event_feed, ["v_gate"], f"SELECT event_id, lot, plate, ts, kind AS type FROM ({accepted}) a ORDER BY ts DESC, event_id DESC LIMIT 50"),
        "session_display": (gates.session_display, ["v_gate"], f"SELECT entry_id, plate, strftime(entry_ts, '%Y-%m-%dT%H:%M:%S') AS entered, coalesce(strftime(exit_ts, '%Y-%m-%dT%H:%M:%S'), '') AS \"left\", coalesce(CAST(duration_min AS VARCHAR) || ' min', '') AS stay FROM ({sessions}) s"),
        "source_route": (gates.source_route, ["v_frames"], "SELECT event_id, CASE source_id WHEN 0 THEN 'plate' ELSE 'face' END AS source FROM {v_frames} f WHERE source_id < 2"),
        "like_scope": (gates.like_scope, ["v_gate"], "SELECT event_id, plate FROM {v_gate} g WHERE plate LIKE 'P1_%'"),
        "scan_active": (gates.scan_active, ["v_active"], "SELECT id, plate, identity FROM {v_active} a"),
        "plate_suffix_join": (gates.plate_suffix_join, ["v_gate", "v_keys"], "SELECT event_id, key FROM {v_gate} g JOIN {v_keys} k ON split_part(k.key, '|', 2) = g.plate"),
        "camera_health": (gates.camera_health, ["v_reads"], "SELECT lane, min(ts) AS up_from, max(ts) AS up_to, count(*) AS frames FROM (SELECT *, sum(late) OVER (PARTITION BY lane ORDER BY ts, event_id) AS period FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY lane ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS late FROM {v_reads} r) a) b GROUP BY lane, period"),
        "sink_events_json": (files.event_json, ["v_gate"], "SELECT event_id, '{\"type\":\"' || kind || '\",\"data\":{\"plate\":\"' || plate || '\",\"lot\":' || CAST(lot AS VARCHAR) || '}}' AS json FROM {v_gate} g"),
    }
