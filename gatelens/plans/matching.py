"""Registered greedy jobs within frames, and label files: operator, input views, SQL for the same rows."""

from __future__ import annotations

from ..operators import matching
from ..sources import files

_IOU = "(SELECT *, CASE WHEN un > 0 THEN inter / un ELSE 0 END AS iou FROM (SELECT *, areas - inter AS un FROM (SELECT a.frame_id, det_id, truth_id, conf, a.ch, b.ch AS true_ch, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas FROM {v_det_ch} a JOIN {v_truth_ch} b ON a.frame_id = b.frame_id) p) q)"
_MEET = "greatest(0, least(k.x2, x[1].x2) - greatest(k.x1, x[1].x1)) * greatest(0, least(k.y2, x[1].y2) - greatest(k.y1, x[1].y1))"
_AREAS = "((k.x2 - k.x1) * (k.y2 - k.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1))"


def _taken(order: str) -> str:
    """Frames with the pairs taken in order, as lists of one pair folded into one list."""
    return f"""SELECT frame_id, unnest(list_reduce(pairs, lambda held, x: CASE WHEN len(list_filter(held, lambda k: k.d = x[1].d OR k.t = x[1].t)) > 0 THEN held ELSE list_concat(held, x) END)) AS p
 FROM (SELECT frame_id, list([{{'d': det_id, 't': truth_id, 'same': ch = true_ch, 'ch': ch, 'true': true_ch}}] ORDER BY {order}) AS pairs FROM {_IOU} i WHERE iou >= 0.5 GROUP BY frame_id) f"""


_PRF = "round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-6), 6) AS f1"
_CHARS = f"""SELECT frame_id, CAST(tp AS BIGINT) AS tp, CAST(n - tp - err AS BIGINT) AS fp, CAST(m - tp - err AS BIGINT) AS fn, CAST(err AS BIGINT) AS cls_err, tp = m AND n = tp + err AS exact FROM
 (SELECT frame_id, sum(n) AS n, sum(m) AS m, sum(tp) AS tp, sum(err) AS err FROM (SELECT frame_id, 1 AS n, 0 AS m, 0 AS tp, 0 AS err FROM {{v_det_ch}} d UNION ALL SELECT frame_id, 0, 1, 0, 0 FROM {{v_truth_ch}} t
 UNION ALL SELECT frame_id, 0, 0, CAST(p.same AS INT), CAST(NOT p.same AS INT) FROM ({_taken('iou DESC, det_id DESC, truth_id DESC')}) g) u GROUP BY frame_id) s"""
_LABELS = "SELECT stem, line_no, CAST(f[1] AS INT) AS cls_id, substring('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1 + CAST(f[1] AS INT), 1) AS ch, CAST(f[2] AS DOUBLE) AS cx, CAST(f[3] AS DOUBLE) AS cy, CAST(f[4] AS DOUBLE) AS w, CAST(f[5] AS DOUBLE) AS h FROM (SELECT stem, line_no, regexp_split_to_array(trim(line), '\\s+') AS f FROM {v_label_lines} l) q WHERE len(f) >= 5 AND TRY_CAST(f[1] AS INT) BETWEEN 0 AND 35"

SPECS = {
    "nms": (matching.nms, ["v_det"], f"SELECT frame_id, b.det_id AS det_id, b.conf AS conf FROM (SELECT frame_id, unnest(list_reduce(boxes, lambda held, x: CASE WHEN len(list_filter(held, lambda k: {_MEET} / ({_AREAS} - {_MEET}) > 0.45)) > 0 THEN held ELSE list_concat(held, x) END)) AS b FROM (SELECT frame_id, list([{{'det_id': det_id, 'conf': conf, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY conf DESC, det_id) AS boxes FROM {{v_det}} d GROUP BY frame_id) f) g"),
    "detection_eval": (matching.detection_eval, ["v_det_ch", "v_truth_ch"], f"SELECT tp, fp, fn, {_PRF} FROM (SELECT tp, n - tp AS fp, m - tp AS fn FROM (SELECT count(*) AS tp FROM ({_taken('conf DESC, det_id, iou DESC, truth_id')}) g) a, (SELECT count(*) AS n FROM {{v_det_ch}} d) b, (SELECT count(*) AS m FROM {{v_truth_ch}} t) c) r"),
    "confusion_counts": (matching.confusion_counts, ["v_det_ch", "v_truth_ch"], f"SELECT p.true AS truth, p.ch AS said, count(*) AS n FROM ({_taken('iou DESC, det_id DESC, truth_id DESC')}) g WHERE NOT p.same GROUP BY ALL ORDER BY n DESC, truth, said LIMIT 100"),
    "char_eval": (matching.char_eval, ["v_det_ch", "v_truth_ch"], _CHARS),
    "prf_from_counts": (matching.char_prf, ["v_det_ch", "v_truth_ch"], f"SELECT tp, fp, fn, {_PRF} FROM (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp + cls_err) AS BIGINT) AS fp, CAST(sum(fn + cls_err) AS BIGINT) AS fn FROM ({_CHARS}) c) r"),
    "decode_anchors": (matching.decode_anchors, ["v_anchors"], "SELECT frame_id, CAST(i - 1 AS BIGINT) AS at, CASE WHEN scores[1][i] >= scores[2][i] THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS cls, greatest(scores[1][i], scores[2][i]) AS conf, cx[i] - w[i] / 2 AS x1, cy[i] - h[i] / 2 AS y1, cx[i] + w[i] / 2 AS x2, cy[i] + h[i] / 2 AS y2 FROM (SELECT *, unnest(range(1, 4)) AS i FROM {v_anchors} a) q WHERE greatest(scores[1][i], scores[2][i]) >= 0.4"),
    "scan_box_labels": (files.box_labels, ["v_label_lines"], _LABELS),
    "label_line_counts": (files.label_line_counts, ["v_label_lines"], "SELECT CASE WHEN trim(line) = '' THEN 'blank' WHEN len(f) < 5 THEN 'short' WHEN TRY_CAST(f[1] AS INT) IS NULL THEN 'unparsable' WHEN TRY_CAST(f[1] AS INT) NOT BETWEEN 0 AND 35 THEN 'class' ELSE 'kept' END AS status, count(*) AS n FROM (SELECT line, regexp_split_to_array(trim(line), '\\s+') AS f FROM {v_label_lines} l) q GROUP BY 1"),
    "truth_line_counts": (files.truth_line_counts, ["v_truth_lines"], "SELECT CASE WHEN trim(line) = '' THEN 'blank' WHEN NOT regexp_matches(line, '[\\t,]') THEN 'unsplit' WHEN trim(regexp_extract(line, '^([^\\t,]*)[\\t,]', 1)) = '' THEN 'nameless' ELSE 'read' END AS status, count(*) AS n FROM {v_truth_lines} t GROUP BY 1"),
    "label_audit": (lambda lines: files.label_audit(files.box_labels(lines)), ["v_label_lines"], f"SELECT c AS cls_id, count(stem) AS n, CASE WHEN count(stem) = 0 THEN 'no data' END AS flag FROM range(36) r(c) LEFT JOIN ({_LABELS}) l ON l.cls_id = c GROUP BY c"),
    "scan_text_truth": (files.text_truth, ["v_truth_lines"], "SELECT name, regexp_replace(name, '\\.[^.]*$', '') AS stem, translate(upper(trim(arg_max(txt, line_no))), ' -._', '') AS text FROM (SELECT line_no, trim(regexp_extract(line, '^([^\\t,]*)[\\t,](.*)$', 1)) AS name, regexp_extract(line, '^([^\\t,]*)[\\t,](.*)$', 2) AS txt FROM {v_truth_lines} t) q WHERE name <> '' GROUP BY name"),
    "pair_samples": (files.pair_samples, ["v_truth_lines", "v_label_lines"], "SELECT DISTINCT stem FROM (SELECT CAST(line_no AS VARCHAR) AS stem FROM {v_truth_lines} t) i WHERE stem IN (SELECT stem FROM {v_label_lines} l)"),
}
