"""Test views over the star-schema tables: detections, truth boxes, characters, reads, gate events, faces, gallery, probes.

The SQL is common to Spark and DuckDB; ``{table}`` stands for an input table or another view."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_det": """SELECT l_orderkey AS frame_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS det_id,
 CAST(l_partkey % 200 AS INT) AS x1, CAST(l_suppkey % 100 AS INT) AS y1, CAST(l_partkey % 200 + 60 + l_quantity AS INT) AS x2, CAST(l_suppkey % 100 + 30 + floor(l_quantity / 2) AS INT) AS y2,
 CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 997 AS DOUBLE) / 997 AS conf, l_linenumber AS k FROM {lineitem}""",
    "v_truth": """SELECT frame_id, det_id AS truth_id, x1 + (k % 4) * 4 AS x1, y1 + (k % 3) * 3 AS y1, x2 + (k % 4) * 4 AS x2, y2 + (k % 3) * 3 AS y2 FROM {v_det} d WHERE det_id % 2 = 1""",
    "v_chars": """SELECT l_orderkey AS crop_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS char_id,
 substring('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(1 + l_suppkey % 36 AS INT), 1) AS ch, CAST(l_partkey % 300 AS DOUBLE) AS cx,
 CAST((l_linenumber % 2) * 40 + l_suppkey % 7 AS DOUBLE) AS cy, CAST(24 + l_partkey % 6 AS DOUBLE) AS h,
 CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 997 AS DOUBLE) / 997 AS conf FROM {lineitem}""",
    "v_reads": """SELECT event_id, user_id AS lane, ts, base, CASE event_type WHEN 'error' THEN '' WHEN 'click' THEN lower(substring(base, 1, 4)) || '-' || substring(base, 5, 5)
  WHEN 'signup' THEN replace(base, '0', 'O') WHEN 'purchase' THEN substring(base, 1, 4) || '-' || substring(base, 5, 3) || '.' || substring(base, 8, 2) ELSE base END AS raw,
 CASE WHEN event_id % 5 = 0 THEN translate(base, '058', 'ODB') WHEN event_id % 7 = 0 THEN substring(base, 1, 8) ELSE base END AS pred
FROM (SELECT *, CAST(10 + user_id % 90 AS STRING) || chr(CAST(65 + user_id % 8 AS INT)) || CAST(user_id % 10 AS STRING) || CAST(CAST(10000 + (user_id * 7919 + floor(rn / 7) * 104729) % 89999 AS INT) AS STRING) AS base
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {events} e) a) b""",
    "v_seen": """SELECT event_id, user_id AS lane, ts FROM {events} e""",
    "v_mode_reads": """SELECT event_id, lane, ts, CASE WHEN event_id % 13 = 0 THEN '' ELSE raw END AS raw, CASE WHEN event_id % 13 = 0 THEN 'clear' END AS control FROM {v_reads} r""",
    "v_read_conf": """SELECT event_id, base, pred, CASE WHEN event_id % 17 > 0 THEN CAST(event_id * 37 % 101 AS DOUBLE) / 101 END AS conf FROM {v_reads} r""",
    "v_read_chars": """SELECT event_id, CAST(p.pos AS BIGINT) AS pos, substring(pred, p.pos, 1) AS ch, CASE WHEN event_id % 19 > 0 THEN CAST((event_id * 37 + p.pos * 53) % 11 AS DOUBLE) / 11 END AS conf
 FROM {v_reads} r CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) AS p(pos) WHERE p.pos <= length(pred)""",
    "v_gate": """SELECT event_id, user_id % 5 AS lot, 'P' || CAST(user_id AS STRING) AS plate, ts, CASE WHEN event_type IN ('signup', 'view') THEN 'entry' ELSE 'exit' END AS kind FROM {events} e WHERE event_type <> 'error'""",
    "v_faces": """SELECT event_id AS image_id, user_id AS lane, ts, value AS blur, CAST(event_id * 7 % 256 AS DOUBLE) AS brightness, CAST(40 + event_id % 160 AS INT) AS w, CAST(40 + event_id % 120 AS INT) AS h, CAST(event_id % 3 AS INT) AS n_faces FROM {events} e""",
    "v_active": """SELECT vec_id AS id, CAST(floor(vec_id / 2) AS INT) % 5 AS lot, 'P' || CAST(CAST(floor(vec_id / 2) AS INT) AS STRING) AS plate, label AS identity, embedding FROM {embeddings} e WHERE vec_id % 2 = 0""",
    "v_exit": """SELECT vec_id AS id, CAST(floor(vec_id / 2) AS INT) % 5 + (CASE WHEN vec_id % 14 = 3 THEN 1 ELSE 0 END) AS lot, 'P' || CAST(CAST(floor(vec_id / 2) + (CASE WHEN vec_id % 10 = 1 THEN 1000000 ELSE 0 END) AS INT) AS STRING) AS plate, label AS identity, embedding FROM {embeddings} e WHERE vec_id % 2 = 1""",
    "v_parked": """SELECT e.vec_id AS id, CAST(floor(e.vec_id / 12) AS INT) % 3 AS lot, 'P' || CAST(CAST(floor(e.vec_id / 12) AS INT) AS STRING) AS plate, v.ts AS entry_ts, CASE WHEN e.vec_id % 33 > 0 THEN e.embedding END AS embedding
 FROM {embeddings} e JOIN {events} v ON v.event_id = e.vec_id WHERE e.vec_id % 3 = 0""",
    "v_leaving": """SELECT e.vec_id AS id, CAST(floor(e.vec_id / 12) AS INT) % 3 AS lot, CASE WHEN e.vec_id % 31 > 0 THEN 'P' || CAST(CAST(floor(e.vec_id / 12) AS INT) AS STRING) END AS plate, v.ts AS ts, e.embedding
 FROM {embeddings} e JOIN {events} v ON v.event_id = e.vec_id + 300 WHERE e.vec_id % 3 <> 0""",
    "v_det_ch": """SELECT *, substring('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(1 + det_id % 36 AS INT), 1) AS ch FROM {v_det} d""",
    "v_truth_ch": """SELECT *, substring('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(1 + (truth_id + (CASE WHEN x1 % 5 = 0 THEN 1 ELSE 0 END)) % 36 AS INT), 1) AS ch FROM {v_truth} t""",
    "v_anchors": """SELECT event_id AS frame_id, array(CAST(event_id % 50 AS DOUBLE), CAST(event_id % 60 AS DOUBLE), CAST(30 AS DOUBLE)) AS cx, array(CAST(event_id % 40 AS DOUBLE), CAST(12 AS DOUBLE), CAST(20 AS DOUBLE)) AS cy, array(CAST(8 AS DOUBLE), CAST(10 AS DOUBLE), CAST(event_id % 9 AS DOUBLE)) AS w, array(CAST(4 AS DOUBLE), CAST(6 AS DOUBLE), CAST(8 AS DOUBLE)) AS h,
  array(array(CAST(event_id % 100 AS DOUBLE) / 100, CAST(0.5 AS DOUBLE), CAST(event_id % 7 AS DOUBLE) / 7), array(CAST(event_id % 90 AS DOUBLE) / 90, CAST(0.5 AS DOUBLE), CAST(event_id % 11 AS DOUBLE) / 11)) AS scores FROM {events} e""",
    "v_samples": """SELECT r.event_id AS i, r.raw AS entry_raw, r.pred AS exit_raw, CASE r.event_id % 10 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS entry_faces, CASE WHEN r.event_id % 8 = 0 THEN 0 ELSE 1 END AS exit_faces, g.embedding AS gallery, p.embedding AS probe
 FROM {v_reads} r CROSS JOIN (SELECT count(*) AS n FROM {embeddings} c) m JOIN {embeddings} g ON g.vec_id = r.event_id % m.n JOIN {embeddings} p ON p.vec_id = r.event_id * 7 % m.n""",
    "v_earlier": """SELECT -1 - r.event_id AS id, r.raw, e.embedding AS gallery FROM {v_reads} r CROSS JOIN (SELECT count(*) AS n FROM {embeddings} c) m JOIN {embeddings} e ON e.vec_id = r.event_id * 3 % m.n WHERE r.event_id % 3 = 0""",
    "v_face_vectors": """SELECT f.image_id, f.lane, f.ts, CASE WHEN f.blur >= 50 THEN f.blur / 500 END AS quality, e.embedding FROM {v_faces} f CROSS JOIN (SELECT count(*) AS n FROM {embeddings} c) m JOIN {embeddings} e ON e.vec_id = f.image_id % m.n""",
    "v_rotations": """SELECT CAST(floor(image_id / 4) AS BIGINT) AS image, CAST(image_id % 4 AS INT) AS code, CASE WHEN image_id % 5 < 3 THEN 0 ELSE 1 END AS n_faces FROM {v_faces} f""",
    "v_frames": """SELECT event_id, CAST(user_id % 3 AS INT) AS source_id FROM {events} e""",
    "v_keys": """SELECT 'FULL_' || CAST(id AS STRING) || '|' || plate AS key FROM {v_active} a""",
    "v_scaling": """SELECT CASE event_id % 5 WHEN 0 THEN 10 WHEN 1 THEN 50 WHEN 2 THEN 100 WHEN 3 THEN 200 ELSE 500 END AS n, CASE WHEN event_id % 2 = 0 THEN 'insert' ELSE 'search' END AS op, value AS ms FROM {events} e""",
    "v_gate_frames": """SELECT r.event_id, r.lane % 5 AS lot, r.lane, r.ts, CASE WHEN extract(DAY FROM r.ts) % 2 = 0 THEN 'entry' ELSE 'exit' END AS kind, r.raw, f.quality, f.embedding FROM {v_reads} r JOIN {v_face_vectors} f ON f.image_id = r.event_id""",
    "v_label_lines": """SELECT CAST(frame_id AS STRING) AS stem, det_id AS line_no, CASE WHEN x1 % 17 = 0 THEN '' WHEN x1 % 13 = 0 THEN '7 0.5 0.5' WHEN x1 % 11 = 0 THEN '99 0.5 0.5 0.1 0.1' WHEN x1 % 7 = 0 THEN 'x 0.5 0.5 0.1 0.1'
  ELSE CAST(x1 % 36 AS STRING) || ' 0.' || CAST(10 + y1 % 80 AS STRING) || ' 0.5 0.25 0.125' END AS line FROM {v_det} d""",
    "v_truth_lines": """SELECT event_id AS line_no, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'damaged' ELSE 'img' || CAST(event_id % 700 AS STRING) || '.jpg' || (CASE WHEN event_id % 2 = 0 THEN chr(9) ELSE ',' END) || raw END AS line FROM {v_reads} r""",
    "v_variants": """SELECT CAST(floor(event_id / 3) AS BIGINT) AS crop_id, event_id % 3 AS variant, raw AS text, CAST(event_id * 37 % 101 AS DOUBLE) / 101 AS conf, CASE WHEN event_id % 4 > 0 THEN CAST(event_id * 37 % 101 AS DOUBLE) / 101 END AS score FROM {v_reads} r""",
    "v_vector_text": """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN '[' || CAST(event_id AS STRING) || '.5, ' || CAST(event_id % 7 AS STRING) || '.25,3]' WHEN 1 THEN CAST(event_id AS STRING) || ' 1 2' WHEN 2 THEN '[1,2]' WHEN 3 THEN 'x,1,2' ELSE '' END AS txt FROM {events} e""",
    "v_timing": """SELECT event_type AS stage, value AS ms FROM {events} e""",
}


def view(spark: SparkSession, sf_dir: str, name: str, feed: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table of the folder, or a view over its tables; ``feed`` has what stands for a table's file, a stream for instance."""
    if feed and name in feed:
        return feed[name]
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    names = sorted(set(re.findall(r"\{(\w+)\}", VIEWS[name])))
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n, feed) for n in names})


def inlined(sql: str) -> str:
    """SQL in which every ``{view}`` is written out over the tables."""
    return re.sub(r"\{(\w+)\}", lambda m: f"({inlined(VIEWS[m[1]])})" if m[1] in VIEWS else m[1], sql)
