"""The registered queries of the gate and identity operators, each with SQL for the same rows over the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import boxes, gates, identity, reports
from ..sources.views import VIEWS, inlined, view
from ..streaming.counts import stream_hourly_counts
from ..streaming.jobs import stream_gate_source, streamed
from . import evaluate, flows, matching, search, text

IOU = """CASE WHEN un > 0 THEN inter / un ELSE 0.0 END"""
ACCEPTED = "SELECT * FROM (SELECT *, coalesce(lag(kind) OVER (PARTITION BY lot, plate ORDER BY ts, event_id), 'exit') AS before FROM {v_gate} g) q WHERE kind <> before"
SESSIONS = f"""SELECT lot, plate, event_id AS entry_id, ts AS entry_ts, exit_ts, CAST((epoch_us(exit_ts) - epoch_us(ts)) // 60000000 AS BIGINT) AS duration_min
 FROM (SELECT *, lead(ts) OVER (PARTITION BY lot, plate ORDER BY ts, event_id) AS exit_ts FROM ({ACCEPTED}) a) b WHERE kind = 'entry'"""
GATE = "blur >= 50 AND brightness > 30 AND brightness < 230"
EXCLUDE = ["v_reads", "v_chars", "v_det", "v_truth"]
_GONE = "SELECT event_id FROM {v_reads} g WHERE regexp_matches(pred, '^[0-9]{2}[A-Z][0-9]{6}$')"
_SETS = "SELECT 'truth' AS part, event_id AS id FROM {v_reads} r UNION ALL SELECT DISTINCT 'crops', crop_id FROM {v_chars} c UNION ALL SELECT 'characters', crop_id FROM {v_chars} d UNION ALL SELECT DISTINCT 'frames', frame_id FROM {v_det} e UNION ALL SELECT 'boxes', frame_id FROM {v_truth} t"

#: name -> operator, its input tables or views, SQL.
SPECS: dict[str, tuple[Callable[..., DataFrame], list[str], str | None]] = {
    "conf_filter": (boxes.conf_filter, ["v_det"], "SELECT * FROM {v_det} d WHERE conf >= 0.4"),
    "box_geometry": (boxes.box_geometry, ["v_det"], "SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h FROM {v_det} d"),
    "box_clamp": (boxes.box_clamp, ["v_det"], "SELECT * FROM (SELECT frame_id, det_id, least(greatest(x1, 0), 200) AS x1, least(greatest(y1, 0), 100) AS y1, least(greatest(x2, 0), 200) AS x2, least(greatest(y2, 0), 100) AS y2, conf FROM {v_det} d) q WHERE x2 > x1 AND y2 > y1"),
    "box_margin_clip": (boxes.box_margin_clip, ["v_det"], "SELECT *, x2 <= x1 OR y2 <= y1 AS empty FROM (SELECT frame_id, det_id, greatest(0, x1 - mx) AS x1, greatest(0, y1 - my) AS y1, least(300, x2 + mx) AS x2, least(200, y2 + my) AS y2 FROM (SELECT *, greatest(10, CAST(trunc(0.08::DOUBLE * (x2 - x1)) AS INT)) AS mx, greatest(8, CAST(trunc(0.12::DOUBLE * (y2 - y1)) AS INT)) AS my FROM {v_det} d) a) b"),
    "best_box": (boxes.best_box, ["v_det"], "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY conf DESC NULLS LAST, det_id) AS r FROM {v_det} d) q WHERE r = 1"),
    "char_cap": (boxes.char_cap, ["v_chars"], "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY conf DESC NULLS LAST, char_id) AS r FROM {v_chars} d) q WHERE r <= 9"),
    "iou_pair_join": (boxes.iou_pair_join, ["v_det", "v_truth"], f"SELECT frame_id, det_id, truth_id, {IOU} AS iou FROM (SELECT *, areas - inter AS un FROM (SELECT a.frame_id, det_id, truth_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas FROM {{v_det}} a JOIN {{v_truth}} b ON a.frame_id = b.frame_id) p) q WHERE {IOU} >= 0.5"),
    "session_pairing": (gates.session_pairing, ["v_gate"], SESSIONS),
    "occupancy_timeline": (gates.occupancy_timeline, ["v_gate"], f"SELECT lot, event_id, ts, CAST(sum(CASE WHEN kind = 'entry' THEN 1 ELSE -1 END) OVER (PARTITION BY lot ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS occupancy FROM ({ACCEPTED}) a"),
    "occupancy_stats": (gates.occupancy_stats, ["v_gate"], f"SELECT lot, current, CAST(500 AS BIGINT) AS capacity, round(100.0::DOUBLE * current / 500, 1) AS pct FROM (SELECT lot, CAST(greatest(sum(CASE WHEN kind = 'entry' THEN 1 ELSE -1 END), 0) AS BIGINT) AS current FROM ({ACCEPTED}) a GROUP BY lot) b"),
    "active_recent": (gates.active_recent, ["v_gate"], f"SELECT lot, plate, entry_id, entry_ts FROM ({SESSIONS}) s WHERE exit_ts IS NULL ORDER BY entry_ts DESC, entry_id DESC LIMIT 50"),
    "history_recent": (gates.history_recent, ["v_gate"], f"SELECT * FROM ({SESSIONS}) s WHERE exit_ts IS NOT NULL ORDER BY exit_ts DESC, entry_id DESC LIMIT 20"),
    "plate_vote": (gates.plate_vote, ["v_reads"], "SELECT event_id, lane, CASE WHEN len(held) >= 3 AND top.n * 2 >= len(held) THEN top.value END AS stable FROM (SELECT *, list_max(list_transform(list_distinct(held), lambda v: {'n': len(list_filter(held, lambda x: x = v)), 'age': -list_position(held, v), 'value': v})) AS top FROM (SELECT event_id, lane, list(raw) OVER (PARTITION BY lane ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS held FROM {v_reads} r WHERE raw <> '') a) b"),
    "frame_sample": (gates.frame_sample, ["v_reads"], "SELECT event_id, lane FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY ts, event_id) AS n FROM {v_reads} r) q WHERE n % 3 = 0"),
    "fps_per_second": (gates.fps_per_second, ["v_reads"], "SELECT lane, CAST(date_trunc('second', ts) AS TIMESTAMP) AS second, count(*) AS frames FROM {v_reads} r GROUP BY ALL"),
    "plate_lookup_join": (identity.plate_lookup_join, ["v_exit", "v_active"], "SELECT x.id, x.lot, x.plate, a.id AS active_id FROM {v_exit} x LEFT JOIN {v_active} a ON a.plate = x.plate AND a.lot = x.lot"),
    "cosine_verify": (identity.cosine_verify, ["v_exit", "v_active"], "SELECT *, sim >= 0.05 AS passed FROM (SELECT x.id, a.id AS active_id, round(list_inner_product(x.embedding::DOUBLE[], a.embedding::DOUBLE[]) / (sqrt(list_inner_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) * sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) + 1e-8), 6) AS sim FROM {v_exit} x JOIN {v_active} a ON a.plate = x.plate) q"),
    "quality_gate": (identity.quality_gate, ["v_faces"], "SELECT image_id, reason = 'ok' AS ok, reason FROM (SELECT image_id, CASE WHEN blur < 50 THEN 'blurry' WHEN brightness <= 30 THEN 'dark' WHEN brightness >= 230 THEN 'bright' ELSE 'ok' END AS reason FROM {v_faces} f) q"),
    "quality_score": (identity.quality_score, ["v_faces"], f"SELECT image_id, CASE WHEN {GATE} THEN 0.5::DOUBLE * least(blur / 500, 1.0::DOUBLE) + 0.2::DOUBLE * (1 - abs(brightness - 128) / 128) + 0.3::DOUBLE * least(w * h / 20000.0::DOUBLE, 1.0::DOUBLE) END AS score FROM {{v_faces}} f"),
    "face_status": (identity.face_status, ["v_faces"], "SELECT CASE WHEN n_faces = 1 THEN 'ok' WHEN n_faces = 0 THEN 'no_face' ELSE 'multi_face' END AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {v_faces} f GROUP BY 1"),
    "first_n_per_group": (identity.first_n_per_group, ["v_active"], "SELECT * FROM (SELECT identity, id, row_number() OVER (PARTITION BY identity ORDER BY id) AS place FROM {v_active} a) q WHERE place <= 2"),
    "split_hold_out": (identity.split_hold_out, ["v_active"], "SELECT id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) <= floor(count(*) OVER () * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS part FROM {v_active} a"),
    "latency_summary": (identity.latency_summary, ["v_timing"], "SELECT stage, count(ms) AS n, round(avg(ms), 6) AS mean, round(stddev_pop(ms), 6) AS std, min(ms) AS low, max(ms) AS high, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99, round(CASE WHEN avg(ms) > 0 THEN 1000 / avg(ms) ELSE 0.0 END, 6) AS fps FROM {v_timing} t GROUP BY stage"),
    "value_histogram": (identity.value_histogram, ["v_timing"], "SELECT CAST(CASE WHEN hi > lo THEN least(floor((ms - lo) / ((hi - lo) / 25)), 24) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM {v_timing} t, (SELECT min(ms) AS lo, max(ms) AS hi FROM {v_timing} u) s WHERE ms IS NOT NULL GROUP BY 1"),
    "edit_cer": (identity.edit_cer, ["v_reads"], "SELECT event_id, CAST(levenshtein(base, pred) AS BIGINT) AS dist, round(levenshtein(base, pred) / greatest(length(base), 1), 6) AS cer FROM {v_reads} r"),
    "event_union": (reports.event_union, ["v_gate"], f"SELECT event_id, lot, plate, ts, kind AS type FROM ({ACCEPTED}) a"),
    "active_from_events": (reports.active_from_events, ["v_gate"], f"SELECT lot, plate, entry_id, entry_ts FROM ({SESSIONS}) s WHERE exit_ts IS NULL"),
    "dup_semi_join": (reports.dup_semi_join, ["v_gate"], "SELECT event_id, lot, plate, ts FROM (SELECT *, lag(kind) OVER (PARTITION BY lot, plate ORDER BY ts, event_id) AS before FROM {v_gate} g) q WHERE kind = 'entry' AND before = 'entry'"),
    "prefix_group": (reports.prefix_group, ["v_reads"], "SELECT split_part(raw, '-', 1) AS prefix, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM {v_reads} r WHERE raw <> '' GROUP BY 1"),
    "min_group_size": (reports.min_group_size, ["v_gate"], "SELECT event_id, plate FROM (SELECT *, count(*) OVER (PARTITION BY plate) AS n FROM {v_gate} g) q WHERE n >= 2"),
    "pattern_exclude": (reports.excluded_rows, EXCLUDE, f"SELECT part, id, count(*) AS n FROM ({_SETS}) s WHERE id NOT IN ({_GONE}) GROUP BY part, id"),
    "pattern_exclude_counts": (reports.excluded_counts, EXCLUDE, f"SELECT part, count(*) FILTER (id IN ({_GONE})) AS removed, count(*) FILTER (id NOT IN ({_GONE})) AS kept FROM ({_SETS}) s GROUP BY part"),
    "face_image_status": (identity.face_image_status, ["v_faces"], "SELECT image_id, n_faces, CASE n_faces WHEN 1 THEN 'ok' WHEN 0 THEN 'no_face' ELSE 'multi_face' END AS status FROM {v_faces} f"),
    "asof_frames": (reports.asof_frames, ["v_reads", "v_faces"], "SELECT r.event_id, f.image_id FROM {v_reads} r ASOF LEFT JOIN (SELECT * FROM {v_faces} g WHERE n_faces > 0) f ON f.lane = r.lane AND r.ts >= f.ts"),
    "worst_strings": (reports.worst_strings, ["v_reads"], "SELECT * FROM (SELECT event_id, CAST(levenshtein(base, pred) AS BIGINT) AS dist, round(levenshtein(base, pred) / greatest(length(base), 1), 6) AS cer FROM {v_reads} r) q WHERE cer > 0 ORDER BY cer DESC, dist DESC, event_id LIMIT 50"),
    "threshold_sweep": (reports.threshold_sweep, ["v_exit", "v_active"], "SELECT *, round(\"right\" / n, 6) AS acc, row_number() OVER (ORDER BY \"right\" DESC, thr) = 1 AS first_best FROM (SELECT CAST(thr AS INT) AS thr, CAST(sum(CASE WHEN (floor(sim * 100) >= thr) = same THEN 1 ELSE 0 END) AS BIGINT) AS \"right\", count(*) AS n FROM (SELECT x.identity = a.identity AS same, round(list_inner_product(x.embedding::DOUBLE[], a.embedding::DOUBLE[]) / (sqrt(list_inner_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) * sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) + 1e-8), 6) AS sim FROM {v_exit} x JOIN {v_active} a ON a.plate = x.plate) p, range(100) t(thr) GROUP BY 1) w"),
}

SPECS |= text.SPECS | matching.SPECS | search.SPECS | evaluate.specs(ACCEPTED, SESSIONS) | flows.specs(ACCEPTED, SESSIONS)


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    operator, inputs, _ = SPECS[name]
    given = lambda spark, sf_dir, v: streamed(spark, sf_dir, v[1:]) if v.startswith("~") else view(spark, sf_dir, v)
    return lambda spark, sf_dir: operator(*[given(spark, sf_dir, v) for v in inputs])


QUERIES = {name: _query(name) for name in SPECS} | {"stream_hourly_counts": stream_hourly_counts, "stream_gate_source": stream_gate_source}


def _oracle(sql: str) -> str:
    # braces of struct literals are not view names, so only known names are replaced
    # and the views' ``array`` is ``list_value`` there
    return re.sub(r"\{(v_\w+)\}", lambda m: f"({re.sub(r'\barray\(', 'list_value(', inlined(VIEWS[m[1]]))})", sql)


ORACLE_SQL = {name: _oracle(sql) for name, (_, _, sql) in SPECS.items() if sql} | {"stream_hourly_counts": "SELECT user_id AS lane, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n FROM events GROUP BY ALL", "stream_gate_source": "SELECT event_id, user_id % 5 AS lot, user_id AS lane, user_id % 3 AS source, ts, CASE WHEN event_type IN ('signup', 'view') THEN 'entry' ELSE 'exit' END AS kind FROM events WHERE event_type <> 'error'"}
