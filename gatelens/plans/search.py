"""Registered similarity jobs: operator, input views, SQL for the same rows (none where the result rests on a trained index or on turns)."""

from __future__ import annotations

from ..operators import inverted, search

_SIM = "round(list_inner_product(x.embedding::DOUBLE[], a.embedding::DOUBLE[]) / (sqrt(list_inner_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) * sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))), 6)"
_LOW = f"(SELECT x.identity, x.id AS i, a.id AS j, {_SIM} AS sim FROM {{v_active}} x JOIN {{v_active}} a ON x.identity = a.identity AND x.id < a.id)"
_SPLIT = "(SELECT identity, max(id) FILTER (place = 1) AS gallery, max(id) FILTER (place = 2) AS probe FROM (SELECT identity, id, row_number() OVER (PARTITION BY identity ORDER BY md5(CAST(id AS VARCHAR) || ':7'), id) AS place FROM {v_active} a) q WHERE place <= 2 GROUP BY identity HAVING count(*) = 2)"
_TOP1 = f"""(SELECT identity, arg_max(said, (sim, -b)) AS said, max(sim) FILTER (said = identity) AS true_sim, max(sim) AS said_sim, max(sim) FILTER (said <> identity) AS imposter_sim FROM
 (SELECT p.identity, g.identity AS said, a.id AS b, {_SIM} AS sim FROM {_SPLIT} p JOIN {{v_active}} x ON x.id = p.probe, {_SPLIT} g JOIN {{v_active}} a ON a.id = g.gallery) s GROUP BY identity)"""

SPECS = {
    "topk_similar": (search.topk_similar, ["v_exit", "v_active"], f"SELECT * FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY sim DESC, active_id) AS rank, active_id, sim FROM (SELECT x.id, a.id AS active_id, {_SIM} AS sim FROM {{v_exit}} x, {{v_active}} a) p) q WHERE rank <= 3 AND sim >= 0.15"),
    "cross_similarity": (search.cross_similarity, ["v_exit", "v_active"], f"SELECT * FROM (SELECT x.id, a.id AS active_id, {_SIM} AS sim FROM {{v_exit}} x, {{v_active}} a) p WHERE sim >= 0.3"),
    "identity_self_join": (search.low_pairs, ["v_active"], f"SELECT * FROM {_LOW} p WHERE sim <= -0.2"),
    "low_sim_pairs": (search.low_sim_pairs, ["v_active"], f"SELECT count(*) AS n_pairs, count(*) FILTER (sim <= -0.2) AS n_low, round(count(*) FILTER (sim <= -0.2) / greatest(count(*), 1), 6) AS share, count(DISTINCT identity) FILTER (sim <= -0.2) AS identities, min(sim) FILTER (sim <= -0.2) AS lowest, round(avg(sim) FILTER (sim <= -0.2), 6) AS mean, max(sim) FILTER (sim <= -0.2) AS highest FROM {_LOW} p"),
    "lowest_pairs": (search.lowest_pairs, ["v_active"], f"SELECT * FROM {_LOW} p WHERE sim <= -0.2 ORDER BY sim, identity, i, j LIMIT 15"),
    "gallery_probe_split": (search.gallery_probe_split, ["v_active"], f"SELECT * FROM {_SPLIT} s"),
    "top1_accuracy": (search.top1_accuracy, ["v_active"], f"SELECT count(*) AS n, count(*) FILTER (said = identity) AS correct, round(avg(CAST(said = identity AS INT)), 6) AS acc, round(avg(true_sim), 6) AS mean_genuine, round(avg(imposter_sim), 6) AS mean_imposter FROM {_TOP1} t"),
    "top_mismatches": (search.top_mismatches, ["v_active"], f"SELECT identity, said, true_sim, said_sim, round(said_sim - true_sim, 6) AS margin FROM {_TOP1} t WHERE said <> identity ORDER BY margin DESC, identity LIMIT 15"),
    "same_diff_pairs": (search.same_diff_pairs, ["v_active"], "SELECT p.a, p.b, p.same, round(list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS sim FROM (SELECT min(id) AS a, max(id) AS b, true AS same FROM (SELECT identity, id, row_number() OVER (PARTITION BY identity ORDER BY id) AS n FROM {v_active} v) q WHERE n <= 2 AND identity IN (SELECT DISTINCT identity FROM {v_active} f ORDER BY identity LIMIT 100) GROUP BY identity HAVING count(*) = 2 UNION ALL SELECT a, b, false FROM (SELECT min(id) AS a, lead(min(id)) OVER (ORDER BY identity) AS b FROM (SELECT * FROM {v_active} w WHERE identity IN (SELECT DISTINCT identity FROM {v_active} f ORDER BY identity LIMIT 100)) v GROUP BY identity) r WHERE b IS NOT NULL) p JOIN {v_active} x ON x.id = p.a JOIN {v_active} y ON y.id = p.b"),
    "outlier_prune": (search.outlier_prune, ["v_active"], None),
    "ivf_topk": (inverted.ivf_topk, ["v_exit", "v_active"], None),
}
