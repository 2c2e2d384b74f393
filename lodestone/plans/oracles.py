"""DuckDB texts of the queries: named common table expressions, and for each query the ones that it needs."""

from __future__ import annotations

import math
import re

from lodestone.functions import hashing
from lodestone.operators.sketch import BASE_SALT, QUERY_SALT
from lodestone.plans import queries as q
from lodestone.sources.fixtures import MAX_TF

PPM = hashing.PPM
_LO, _HI = (round(x * PPM) for x in q.IDF_RANGE)
_TOKENS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
_TARGETS = ", ".join(f"({t})" for t in q.TARGETS)

CTES: dict[str, str] = {
    "doc_vec": f"SELECT doc_id AS vec_id, tok AS dim, CAST(least(count(*), {MAX_TF}) AS BIGINT) AS val FROM (SELECT doc_id, unnest({_TOKENS}) AS tok FROM documents) x GROUP BY 1, 2",
    "bench_q": f"SELECT item_id AS qid, tok AS dim, CAST(least(count(*), {MAX_TF}) AS BIGINT) AS val FROM (SELECT item_id, unnest({_TOKENS}) AS tok FROM benchmark) x GROUP BY 1, 2",
    "cust_vec": "SELECT o_custkey AS vec_id, l_partkey AS dim, CAST(sum(l_quantity) AS BIGINT) AS val FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "cust_q": f"SELECT vec_id AS qid, dim, val FROM cust_vec WHERE vec_id % {q.CUST_EVERY} = 0",
    "emb_vec": "SELECT vec_id, dim, CAST(round(x * 1e6) AS BIGINT) AS val FROM (SELECT vec_id, CAST(unnest(range(len(embedding))) AS BIGINT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) e WHERE x > 0 AND round(x * 1e6) > 0",
    "emb_q": f"SELECT vec_id AS qid, dim, val FROM emb_vec WHERE vec_id % {q.EMB_EVERY} = 0",
}


def dot(name: str, queries: str, base: str) -> None:
    CTES[name] = f"SELECT qid, vec_id, CAST(sum(a.val * b.val) AS BIGINT) AS ip FROM {queries} a JOIN {base} b USING (dim) GROUP BY 1, 2"


def ranked(rows: str, k: int, by: str = "ip DESC, vec_id", group: str = "qid", columns: str = "qid, rank, vec_id, ip") -> str:
    return f"SELECT {columns} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {group} ORDER BY {by}) AS INTEGER) AS rank FROM {rows}) t WHERE rank <= {k}"


for _name, _q, _v in (("doc", "bench_q", "doc_vec"), ("cust", "cust_q", "cust_vec"), ("emb", "emb_q", "emb_vec")):
    dot(f"{_name}_dot", _q, _v)
CTES["emb_truth"] = ranked("emb_dot", q.K_EMB)


def weights(p: str, base: str, universe: str | None = None) -> None:
    """{p}_df, {p}_raw, {p}_idf, {p}_w: document frequencies to slot layout."""
    CTES[f"{p}_df"] = f"SELECT dim, count(*) AS df FROM {base} GROUP BY dim" if universe is None else f"SELECT u.dim AS dim, count(b.vec_id) AS df FROM {universe} u LEFT JOIN {base} b ON u.dim = b.dim GROUP BY u.dim"
    CTES[f"{p}_raw"] = f"SELECT dim, df, CAST(round((ln(CAST(n AS DOUBLE) / (df + 1)) + 1) * {PPM}) AS BIGINT) AS raw_ppm FROM {p}_df, (SELECT count(DISTINCT vec_id) AS n FROM {base}) c"
    CTES[f"{p}_idf"] = f"SELECT dim, df, raw_ppm, CASE WHEN hi = lo THEN {_LO} ELSE {_LO} + (raw_ppm - lo) * {_HI - _LO} // (hi - lo) END AS idf_ppm FROM {p}_raw, (SELECT min(raw_ppm) AS lo, max(raw_ppm) AS hi FROM {p}_raw) e"
    CTES[f"{p}_len"] = f"SELECT *, greatest(3, least(40, ({q.L_BASE} * idf_ppm + {PPM // 2}) // {PPM})) AS l FROM {p}_idf"
    CTES[f"{p}_w"] = f"SELECT dim, df, raw_ppm, CAST(idf_ppm AS BIGINT) AS idf_ppm, CAST(l AS BIGINT) AS l, CAST(coalesce(sum(l) OVER (ORDER BY dim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix_l FROM {p}_len"


weights("doc", "doc_vec")
weights("emb", "emb_vec")
CTES["part_dims"] = "SELECT p_partkey AS dim FROM part"
weights("custf", "cust_vec", "part_dims")


def layout(p: str, base: str) -> None:
    CTES[f"{p}_fix"] = f"SELECT dim, CAST({q.BASE_L} AS BIGINT) AS l, CAST((row_number() OVER (ORDER BY dim) - 1) * {q.BASE_L} AS BIGINT) AS prefix_l FROM (SELECT DISTINCT dim FROM {base}) d"


layout("doc", "doc_vec")
layout("emb", "emb_vec")


def slots(name: str, base: str, w: str, id_col: str, salt: int, use_idf: bool = True, where: str = "", over: str | None = None) -> None:
    """Bernoulli slots: `over` is the divisor of values, a vector's own largest by default."""
    top = over or f"max(val) OVER (PARTITION BY {id_col})"
    p = f"least({PPM}, norm * idf_ppm // {PPM})" if use_idf else "norm"
    idf_col = ", idf_ppm" if use_idf else ""
    CTES[name] = (
        f"SELECT {id_col}, CAST(slot AS BIGINT) AS slot FROM (SELECT {id_col}, {p} AS p, unnest(range(prefix_l, prefix_l + l)) AS slot FROM "
        f"(SELECT {id_col}, dim, greatest(0, least({PPM}, val * {PPM} // {top})) AS norm FROM {base} {where}) n JOIN (SELECT dim, l, prefix_l{idf_col} FROM {w}) w USING (dim)) s WHERE {hashing.draw(id_col, 'slot', salt)} < p"
    )


slots("emb_slots", "emb_vec", "emb_w", "vec_id", BASE_SALT)
slots("emb_lim_slots", "emb_vec", "emb_w", "vec_id", BASE_SALT, where=f"WHERE dim < {q.DIM_LIMIT}")
slots("doc_slots", "doc_vec", "doc_w", "vec_id", BASE_SALT)
slots("emb_qslots", "emb_q", "emb_w", "qid", QUERY_SALT)
slots("doc_fslots", "doc_vec", "doc_fix", "vec_id", BASE_SALT, False, over="(SELECT max(val) FROM doc_vec)")
slots("emb_fslots", "emb_vec", "emb_fix", "vec_id", BASE_SALT, False, over="(SELECT max(val) FROM emb_vec)")
slots("emb_fqslots", "emb_q", "emb_fix", "qid", QUERY_SALT, False)


def signatures(name: str, members: str, slot_table: str, w: str, id_col: str) -> None:
    """Least hashes of the members (id, cluster_id, m_i); the empty set has domain - 1."""
    a, b = hashing.family_a("h", "cluster_id", q.SEED), hashing.family_b("h", "cluster_id", q.SEED)
    CTES[f"{name}_dom"] = f"SELECT CAST(sum(l) + 1 AS BIGINT) AS d FROM {w}"
    CTES[name] = (
        f"SELECT cluster_id, {id_col}, h, CAST(min(CASE WHEN slot IS NULL THEN d - 1 ELSE {hashing.affine_hash(a, b, 'slot', 'd')} END) AS BIGINT) AS mh FROM "
        f"(SELECT m.{id_col} AS {id_col}, CAST(cluster_id AS BIGINT) AS cluster_id, slot, unnest(range(CAST(m_i AS BIGINT))) AS h FROM {members} m LEFT JOIN {slot_table} s ON m.{id_col} = s.{id_col}) x, {name}_dom GROUP BY 1, 2, 3"
    )


CTES["doc_one"] = "SELECT DISTINCT vec_id, 0 AS cluster_id, 16 AS m_i FROM doc_vec"
CTES["emb_one"] = f"SELECT DISTINCT vec_id, 0 AS cluster_id, {q.BASE_M} AS m_i FROM emb_vec"
CTES["emb_qone"] = f"SELECT DISTINCT qid, 0 AS cluster_id, {q.BASE_M} AS m_i FROM emb_q"
signatures("doc_sig", "doc_one", "doc_slots", "doc_w", "vec_id")
signatures("emb_fsig", "emb_one", "emb_fslots", "emb_fix", "vec_id")
signatures("emb_fqsig", "emb_qone", "emb_fqslots", "emb_fix", "qid")

# Clustering: seeds, then rounds of assignment and update, unrolled


def _unit(sums: str) -> str:
    return f"SELECT cluster_id, dim, w FROM (SELECT s.cluster_id AS cluster_id, dim, CAST(round(CAST(s AS DOUBLE) * {PPM} / sqrt(t)) AS BIGINT) AS w FROM ({sums}) s JOIN (SELECT cluster_id, CAST(sum(CAST(s AS HUGEINT) * s) AS DOUBLE) AS t FROM ({sums}) z GROUP BY 1) n ON s.cluster_id = n.cluster_id WHERE t > 0) u WHERE w <> 0"


CTES["km_seeds"] = f"SELECT vec_id, row_number() OVER (ORDER BY r, vec_id) - 1 AS cluster_id FROM (SELECT vec_id, r FROM (SELECT DISTINCT vec_id, {hashing.draw('vec_id', '0', q.SEED)} AS r FROM emb_vec) d ORDER BY r, vec_id LIMIT {q.CLUSTERS}) f"
CTES["km_c0"] = _unit("SELECT cluster_id, dim, CAST(sum(val) AS BIGINT) AS s FROM emb_vec JOIN km_seeds USING (vec_id) GROUP BY 1, 2")
for _r in range(q.ROUNDS):
    CTES[f"km_s{_r}"] = f"SELECT vec_id, cluster_id, CAST(sum(val * w) AS BIGINT) AS score FROM emb_vec JOIN km_c{_r} USING (dim) GROUP BY 1, 2"
    CTES[f"km_a{_r}"] = f"SELECT v.vec_id AS vec_id, CAST(CASE WHEN score > 0 THEN cluster_id ELSE 0 END AS BIGINT) AS cluster_id FROM (SELECT DISTINCT vec_id FROM emb_vec) v LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cluster_id) AS r FROM km_s{_r}) x WHERE r = 1) b ON v.vec_id = b.vec_id"
    CTES[f"km_n{_r + 1}"] = _unit(f"SELECT cluster_id, dim, CAST(sum(val) AS BIGINT) AS s FROM emb_vec JOIN km_a{_r} USING (vec_id) GROUP BY 1, 2")
    CTES[f"km_c{_r + 1}"] = f"SELECT CAST(cluster_id AS BIGINT) AS cluster_id, dim, w FROM (SELECT * FROM km_n{_r + 1} UNION ALL SELECT * FROM km_c{_r} WHERE cluster_id NOT IN (SELECT cluster_id FROM km_n{_r + 1})) u"
_A, _C = f"km_a{q.ROUNDS - 1}", f"km_c{q.ROUNDS}"
CTES["km_scores"] = f"SELECT vec_id, cluster_id, CAST(sum(val * w) AS BIGINT) AS score FROM emb_vec JOIN {_C} USING (dim) GROUP BY 1, 2"
CTES["km_own"] = f"SELECT s.vec_id AS vec_id, s.cluster_id AS own, score AS best FROM km_scores s JOIN {_A} a ON s.vec_id = a.vec_id AND s.cluster_id = a.cluster_id WHERE score > 0"
CTES["km_spill"] = f"SELECT s.vec_id AS vec_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM km_scores s JOIN km_own o ON s.vec_id = o.vec_id WHERE cluster_id <> own AND score * 100 >= best * {q.TAU}"
CTES["km_members"] = f"SELECT vec_id, cluster_id FROM {_A} UNION SELECT vec_id, cluster_id FROM km_spill"
CTES["km_sizes"] = "SELECT cluster_id, count(*) AS n_i FROM km_members GROUP BY 1"
CTES["km_n"] = "SELECT count(DISTINCT vec_id) AS n FROM emb_vec"
_WHOLE = f"ceil(round({q.M0} * greatest(1.0::DOUBLE, round(ln(2.0::DOUBLE * n) / {math.log(2e5)!r}::DOUBLE, 9)), 9))"
CTES["km_params"] = (
    f"SELECT cluster_id, n_i, CAST(greatest(15, least(320, ceil(round({_WHOLE} * greatest(0.3::DOUBLE, least(1.0::DOUBLE, round(ln(2.0::DOUBLE * n_i) / ln(2.0::DOUBLE * n), 9))), 9)))) AS INTEGER) AS m_i, "
    f"CAST(greatest({5 * q.K_EMB}, ceil(round({q.ETA}::DOUBLE * n_i + {q.K_EMB}, 9))) AS INTEGER) AS t_budget FROM km_sizes, km_n"
)
CTES["km_mem_m"] = "SELECT vec_id, cluster_id, m_i FROM km_members JOIN km_params USING (cluster_id)"
signatures("km_sig", "km_mem_m", "emb_slots", "emb_w", "vec_id")

# Search

CTES["route_s"] = f"SELECT qid, cluster_id, CAST(sum(val * w) AS BIGINT) AS s FROM emb_q JOIN {_C} USING (dim) GROUP BY 1, 2"
CTES["route"] = f"SELECT r.qid AS qid, cluster_id, round(CAST(s AS DOUBLE) / {PPM} / top, 9) AS centroid_score, rank FROM ({ranked('route_s', q.NPROBE, 's DESC, cluster_id', columns='*')}) r JOIN (SELECT qid, max(val) AS top FROM emb_q GROUP BY 1) t ON r.qid = t.qid"
CTES["probe_m"] = "SELECT qid, cluster_id, m_i FROM route JOIN km_params USING (cluster_id)"
signatures("q_sig", "probe_m", "emb_qslots", "emb_w", "qid")
CTES["met"] = "SELECT qid, a.cluster_id AS cluster_id, vec_id, count(*) AS cc FROM q_sig a JOIN km_sig b ON a.cluster_id = b.cluster_id AND a.h = b.h AND a.mh = b.mh GROUP BY 1, 2, 3"
CTES["q_size"] = "SELECT qid, count(*) AS sq FROM emb_qslots GROUP BY 1"
CTES["d_size"] = "SELECT vec_id, count(*) AS sd FROM emb_slots GROUP BY 1"
CTES["scored"] = (
    f"SELECT met.qid AS qid, met.cluster_id AS cluster_id, met.vec_id AS vec_id, cc, t_budget, floor((0.7::DOUBLE * round((coalesce(sq, 0) + coalesce(sd, 0)) / (1 + CAST(m_i AS DOUBLE) / cc), 9) / {q.L_BASE} + 0.3::DOUBLE * centroid_score * (CAST(cc AS DOUBLE) / m_i)) * {PPM} + 0.5::DOUBLE) / {PPM} AS score "
    "FROM met JOIN km_params p ON met.cluster_id = p.cluster_id JOIN route r ON met.qid = r.qid AND met.cluster_id = r.cluster_id LEFT JOIN q_size ON met.qid = q_size.qid LEFT JOIN d_size ON met.vec_id = d_size.vec_id"
)
CTES["cands"] = "SELECT qid, cluster_id, vec_id, cc, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid, cluster_id ORDER BY score DESC, vec_id) AS INTEGER) AS place FROM scored) x WHERE place <= t_budget"
CTES["cand_ip"] = "SELECT c.qid AS qid, cluster_id, c.vec_id AS vec_id, ip FROM cands c JOIN emb_dot e ON c.qid = e.qid AND c.vec_id = e.vec_id"
CTES["found_all"] = "SELECT DISTINCT qid, vec_id, ip FROM cand_ip"
CTES["found"] = ranked("found_all", q.K_EMB)
CTES["found_rows"] = ranked("cand_ip", q.K_EMB, "ip DESC, vec_id, cluster_id")
CTES["costs"] = "SELECT qid, count(*) AS n_verified, count(DISTINCT cluster_id) AS n_clusters FROM cands GROUP BY 1"
CTES["proxy_best"] = "SELECT qid, vec_id, cc, score, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY qid, vec_id ORDER BY cc DESC, score DESC, cluster_id) AS r FROM cands) x WHERE r = 1"
CTES["proxy"] = "SELECT qid, vec_id, cc, score, cluster_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY cc DESC, score DESC, vec_id) AS INTEGER) AS place FROM proxy_best) x WHERE place <= 1000"
CTES["base_met"] = "SELECT qid, vec_id, count(*) AS cc, min(a.h) AS first_h FROM emb_fqsig a JOIN emb_fsig b ON a.h = b.h AND a.mh = b.mh GROUP BY 1, 2"
CTES["base_over"] = (
    f"SELECT m.qid AS qid, m.vec_id AS vec_id, cc, round((coalesce(sq, 0) + coalesce(sd, 0)) / (1 + CAST({q.BASE_M} AS DOUBLE) / cc), 9) AS overlap, round(CAST(cc AS DOUBLE) / {q.BASE_M}, 9) AS collision_ratio FROM base_met m "
    "LEFT JOIN (SELECT qid, count(*) AS sq FROM emb_fqslots GROUP BY 1) a ON m.qid = a.qid LEFT JOIN (SELECT vec_id, count(*) AS sd FROM emb_fslots GROUP BY 1) b ON m.vec_id = b.vec_id"
)
CTES["inv"] = "SELECT qid, vec_id, count(*) AS n_common FROM emb_fqslots JOIN emb_fslots USING (slot) GROUP BY 1, 2"


def verified(rows: str, k: int) -> str:
    return ranked(f"(SELECT c.qid AS qid, c.vec_id AS vec_id, ip FROM ({rows}) c JOIN emb_dot e ON c.qid = e.qid AND c.vec_id = e.vec_id) v", k)


def cut(rows: str, by: str, most: int) -> str:
    return f"SELECT qid, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {by}, vec_id) AS place FROM {rows}) x WHERE place <= {most}"


CTES["base_found"] = verified(cut("base_over", "overlap DESC", q.K_EMB + q.UB), q.K_EMB)
CTES["inv_found"] = verified(cut("inv", "n_common DESC", q.K_EMB + q.UB), q.K_EMB)
CTES["bands_d"] = "SELECT vec_id, h // 2 AS band, min(CASE WHEN h % 2 = 0 THEN mh END) AS x, min(CASE WHEN h % 2 = 1 THEN mh END) AS y FROM emb_fsig GROUP BY 1, 2"
CTES["bands_q"] = "SELECT qid, h // 2 AS band, min(CASE WHEN h % 2 = 0 THEN mh END) AS x, min(CASE WHEN h % 2 = 1 THEN mh END) AS y FROM emb_fqsig GROUP BY 1, 2"
CTES["bands_met"] = "SELECT qid, vec_id, count(*) AS cc FROM bands_q a JOIN bands_d b ON a.band = b.band AND a.x = b.x AND a.y = b.y GROUP BY 1, 2"

# Evaluation


def recall(rows: str, count: str = "count(DISTINCT f.vec_id)") -> str:
    return f"SELECT t.qid AS qid, coalesce(n, 0) AS n_hits, round(CAST(coalesce(n, 0) AS DOUBLE) / {q.K_EMB}, 9) AS recall FROM (SELECT DISTINCT qid FROM emb_truth) t LEFT JOIN (SELECT f.qid AS qid, {count} AS n FROM {rows} f WHERE (f.qid, f.vec_id) IN (SELECT (qid, vec_id) FROM emb_truth) GROUP BY 1) h ON t.qid = h.qid"


def mean6(x: str) -> str:
    return f"round(CAST(sum(CAST(round({x} * 1e6) AS BIGINT)) AS DOUBLE) / count(*) / 1e6, 6)"


CTES["recalls"] = recall("found")
CTES["sub_truth"] = ranked(f"(SELECT * FROM emb_dot WHERE vec_id < {q.SUBSET}) s", q.K_EMB)
CTES["base_cut"] = cut("base_over", "overlap DESC", q.K_EMB + q.UB)
CTES["inv_cut"] = cut("inv", "n_common DESC", q.K_EMB + q.UB)


def averages(found: str, candidates: str) -> str:
    """Recall, ratios by rank and cost of an un-clustered method."""
    per = f"SELECT f.qid AS qid, round(CAST(sum(CAST(round(ratio * 1e9) AS BIGINT)) AS DOUBLE) / count(*) / 1e9, 6) AS mean_ratio, arg_max(ratio, rank) AS kth_ratio FROM (SELECT f.qid AS qid, f.rank AS rank, round(CAST(f.ip AS DOUBLE) / t.ip, 9) AS ratio FROM {found} f JOIN emb_truth t ON f.qid = t.qid AND f.rank = t.rank) f GROUP BY 1"
    costs = f"SELECT qid, count(*) AS n_verified FROM {candidates} GROUP BY 1"
    mean = lambda x: f"round(CAST(sum(CAST(round({x} * 1e6) AS BIGINT)) AS DOUBLE) / count({x}) / 1e6, 6)"
    return f"SELECT count(*) AS n_queries, {mean('recall')} AS recall, {mean('mean_ratio')} AS ratio, {mean('kth_ratio')} AS kth_ratio, {mean('coalesce(n_verified, 0)')} AS avg_verified FROM ({recall(found)}) r LEFT JOIN ({per}) p ON r.qid = p.qid LEFT JOIN ({costs}) c ON r.qid = c.qid"


CTES["ratios"] = "SELECT t.qid AS qid, round(least(1.0::DOUBLE, CAST(coalesce(got, 0) AS DOUBLE) / best), 9) AS ratio FROM (SELECT qid, sum(ip) AS best FROM emb_truth GROUP BY 1) t LEFT JOIN (SELECT qid, sum(ip) AS got FROM found GROUP BY 1) f ON t.qid = f.qid"
CTES["aligned"] = "SELECT f.qid AS qid, f.rank AS rank, round(CAST(f.ip AS DOUBLE) / t.ip, 9) AS ratio FROM found f JOIN emb_truth t ON f.qid = t.qid AND f.rank = t.rank"
CTES["covered_t"] = f"SELECT t.qid AS qid, CAST(cut AS INTEGER) AS cut, count(CASE WHEN p.place <= cut THEN 1 END) AS covered FROM (SELECT DISTINCT qid FROM emb_truth) t CROSS JOIN (VALUES {', '.join(f'({c})' for c in q.CUTS)}) c(cut) LEFT JOIN (SELECT * FROM proxy WHERE (qid, vec_id) IN (SELECT (qid, vec_id) FROM emb_truth)) p ON t.qid = p.qid GROUP BY 1, 2"
CTES["coverage_t"] = f"SELECT qid, cut, covered, round(CAST(covered AS DOUBLE) / {q.K_EMB}, 9) AS coverage, round(CAST(covered AS DOUBLE) / cut, 9) AS precision FROM covered_t"
CTES["spear_r"] = "SELECT p.qid AS qid, 2 * rank() OVER (PARTITION BY p.qid ORDER BY cc) + count(*) OVER (PARTITION BY p.qid, cc) - 1 AS x, 2 * rank() OVER (PARTITION BY p.qid ORDER BY ip) + count(*) OVER (PARTITION BY p.qid, ip) - 1 AS y FROM proxy p JOIN emb_dot e ON p.qid = e.qid AND p.vec_id = e.vec_id"
CTES["spear_s"] = "SELECT qid, count(*) AS n, CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE) AS vx, CAST(count(*) * sum(y * y) - sum(y) * sum(y) AS DOUBLE) AS vy, CAST(count(*) * sum(x * y) - sum(x) * sum(y) AS DOUBLE) AS cov FROM spear_r GROUP BY 1"
CTES["spear"] = "SELECT qid, n, round(CASE WHEN n < 2 OR vx <= 0 OR vy <= 0 THEN 0.0::DOUBLE ELSE cov / sqrt(vx) / sqrt(vy) END, 6) AS spearman FROM spear_s"

# Curves

CTES["curve"] = "SELECT p_brand AS dataset, 'm' || (p_partkey % 3) AS method, 'c' || (p_partkey % 7) AS config, p_partkey AS knob, round(0.8::DOUBLE + CAST(p_partkey * 37 % 200 AS DOUBLE) / 1000, 3) AS recall, p_retailprice AS qps, CAST(p_size AS BIGINT) * 100 AS cost FROM part"
CTES["wide"] = f"SELECT curve.*, CAST(target AS DOUBLE) AS target FROM curve, (VALUES {_TARGETS}) t(target)"


def first(rows: str, group: str, order: str, columns: str = "*") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS r FROM {rows}) x WHERE r = 1"


_ROW = "dataset, method, target, config, knob, recall, qps, cost"
CTES["max_best"] = first("(SELECT * FROM wide WHERE recall >= target) y", "dataset, method, target", "qps DESC, config, knob", _ROW)
CTES["max_qps"] = "SELECT e.dataset AS dataset, e.method AS method, e.target AS target, config, knob, recall, qps, cost, CASE WHEN qps IS NULL THEN 'N/A' ELSE 'ok' END AS status FROM (SELECT DISTINCT dataset, method, target FROM wide) e LEFT JOIN max_best b ON e.dataset = b.dataset AND e.method = b.method AND e.target = b.target"
_DEFAULT = "CASE WHEN recall BETWEEN 0.94 AND 0.96 THEN 0 ELSE 1 END, CASE WHEN recall BETWEEN 0.94 AND 0.96 THEN -qps ELSE round(abs(recall - 0.95), 9) END, qps DESC, cost, config, knob"
_HIGH = "CASE WHEN recall >= 0.97 THEN 0 ELSE 1 END, CASE WHEN recall >= 0.97 THEN -recall ELSE round(abs(recall - 0.97), 9) END, qps DESC, config, knob"
_CURVE = "dataset, method, config, knob, recall, qps, cost"
CTES["points"] = f"{first('curve', 'dataset, method', _DEFAULT, _CURVE + chr(44) + ' ' + repr('default') + ' AS role')} UNION ALL {first('curve', 'dataset, method', _HIGH, _CURVE + chr(44) + ' ' + repr('high_recall') + ' AS role')}"


def pivot(cell: str, missing: str = "") -> str:
    cells = ", ".join(f"{missing and 'coalesce('}max(CASE WHEN target = {t} THEN {cell} END){missing and f', {missing})'} AS t{round(t * 100)}" for t in q.TARGETS)
    return f"SELECT dataset, method, {cells} FROM max_qps GROUP BY 1, 2"


def size_row(no: int, name: str, sig: str, extra: str) -> str:
    return (
        f"SELECT {no} AS config_no, '{name}' AS config, (SELECT count(*) FROM {sig} WHERE h = 0) AS n_points, CAST(e AS BIGINT) AS signature_entries, CAST(e * 4 AS BIGINT) AS signature_bytes, b AS n_buckets, b * 16 AS bucket_bytes, CAST(e * 4 AS BIGINT) AS posting_bytes, CAST({extra} AS BIGINT) AS centroid_bytes, CAST(e * 8 + b * 16 + {extra} AS BIGINT) AS total_bytes "
        f"FROM (SELECT sum(n) AS e, count(*) AS b FROM (SELECT cluster_id, h, mh, count(*) AS n FROM {sig} GROUP BY 1, 2, 3) c) z"
    )


_CENTROID_BYTES = f"(SELECT count(*) * 4 + count(DISTINCT cluster_id) * 20 FROM {_C})"
CTES["unspilled"] = f"SELECT s.* FROM km_sig s JOIN {_A} a ON s.vec_id = a.vec_id AND s.cluster_id = a.cluster_id"
_SIZE = "n_points, signature_entries, signature_bytes, n_buckets, bucket_bytes, posting_bytes, centroid_bytes, total_bytes"

FINAL: dict[str, str] = {
    "exact_topk_docs": ranked("doc_dot", q.K_DOCS),
    "exact_topk_cust": ranked("cust_dot", q.K_CUST),
    "exact_topk_emb": "SELECT * FROM emb_truth",
    "padded_topk_cust": ranked("(SELECT q.qid AS qid, v.vec_id AS vec_id, coalesce(ip, 0) AS ip FROM (SELECT DISTINCT qid FROM cust_q) q CROSS JOIN (SELECT DISTINCT vec_id FROM cust_vec) v LEFT JOIN cust_dot d ON q.qid = d.qid AND v.vec_id = d.vec_id) a", 1000),
    "sparse_dot_cust": "SELECT * FROM cust_dot",
    "subset_truth": ranked(f"(SELECT * FROM emb_dot WHERE vec_id < {q.SUBSET}) s", q.K_EMB),
    "query_sample": f"SELECT qid FROM (SELECT DISTINCT qid, {hashing.draw('qid', '1', q.SEED)} AS r FROM emb_q) x ORDER BY r, qid LIMIT 10",
    "truth_csv_rows": "SELECT qid AS query_id, rank, vec_id AS doc_id, ip AS score FROM emb_truth WHERE rank <= 5 AND qid < 1000000",
    "row_norms": "SELECT vec_id, CAST(sum(val * val) AS BIGINT) AS norm_sq, max(val) AS max_val, count(*) AS nnz FROM doc_vec GROUP BY 1",
    "max_normalised": f"SELECT vec_id, dim, val, CAST(greatest(0, least({PPM}, val * {PPM} // max(val) OVER (PARTITION BY vec_id))) AS BIGINT) AS norm_ppm FROM doc_vec",
    "global_max_normalised": f"SELECT vec_id, dim, val, CAST(greatest(0, least({PPM}, val * {PPM} // (SELECT max(val) FROM cust_vec))) AS BIGINT) AS norm_ppm FROM cust_vec",
    "l2_normalised": "SELECT vec_id, dim, val, round(CAST(val AS DOUBLE) / sqrt(CAST(sum(val * val) OVER (PARTITION BY vec_id) AS DOUBLE)), 9) AS unit FROM cust_vec",
    "packed_roundtrip": "SELECT * FROM cust_vec",
    "merged_vectors": "SELECT vec_id, dim, 2 * val AS val FROM cust_vec",
    "norm_range_partition": "SELECT vec_id, norm_sq, level, (row_number() OVER (PARTITION BY level ORDER BY norm_sq, vec_id) - 1) // 64 AS chunk, (row_number() OVER (PARTITION BY level ORDER BY norm_sq, vec_id) - 1) % 64 AS local_id FROM (SELECT *, CAST(floor(round(ln(CAST(norm_sq AS DOUBLE)) / ln(2.0::DOUBLE), 9)) AS BIGINT) AS level FROM (SELECT vec_id, CAST(sum(val * val) AS BIGINT) AS norm_sq FROM cust_vec GROUP BY 1) n) l",
    "affine_hashes": f"SELECT o_orderkey, {hashing.affine_hash('48271', '11', 'o_orderkey', '1009')} AS hash, {hashing.draw('o_orderkey', '3', 5)} AS draw FROM orders",
    "band_keys": "SELECT vec_id, h // 4 AS band, CAST((((sum(CASE WHEN h % 4 = 0 THEN mh END) * 31 + sum(CASE WHEN h % 4 = 1 THEN mh END)) % 1048576 * 31 + sum(CASE WHEN h % 4 = 2 THEN mh END)) % 1048576 * 31 + sum(CASE WHEN h % 4 = 3 THEN mh END)) % 1048576 AS BIGINT) AS key FROM emb_fsig GROUP BY 1, 2",
    "string_tags": "SELECT p_partkey, lower(trim(p_type)) AS tag, regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') AS safe, string_split(p_type, ' ')[1] AS head FROM part",
    "csv_scan": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "row_slice": f"SELECT vec_id, dim, val FROM cust_vec WHERE vec_id = {q.ROW}",
    "smooth_m0": "SELECT p_partkey, CAST(ceil(round(150 + 100 * greatest(0.0::DOUBLE, (CAST(p_partkey % 101 AS DOUBLE) / 100 - 0.5::DOUBLE) / 0.5::DOUBLE), 9)) AS INTEGER) AS m0 FROM part",
    "size_dependent_eta": "SELECT o_orderkey, CASE WHEN o_orderkey * 1000 >= 1000000 THEN 0.03::DOUBLE WHEN o_orderkey * 1000 >= 100000 THEN 0.05::DOUBLE ELSE 0.15::DOUBLE END AS eta FROM orders",
    "minhash_overlap_200": verified(cut("base_over", "overlap DESC", q.K_EMB + 200), q.K_EMB),
    "minhash_overlap_20000": verified(cut("base_over", "overlap DESC", q.K_EMB + 20000), q.K_EMB),
    "cluster_averages": f"SELECT count(*) AS n_queries, {mean6('recall')} AS recall, {mean6('ratio')} AS ratio, {mean6('coalesce(n_verified, 0)')} AS avg_verified, {mean6(str(q.NPROBE))} AS avg_requested, {mean6('coalesce(n_selected, 0)')} AS avg_selected, {mean6('coalesce(n_clusters, 0)')} AS avg_active FROM recalls JOIN ratios USING (qid) LEFT JOIN costs USING (qid) LEFT JOIN (SELECT qid, count(*) AS n_selected FROM route GROUP BY 1) s USING (qid)",
    "subset_benchmark": f"SELECT a.qid AS qid, n_hits, recall, ratio FROM (SELECT t.qid AS qid, coalesce(n, 0) AS n_hits, round(CAST(coalesce(n, 0) AS DOUBLE) / {q.K_EMB}, 9) AS recall FROM (SELECT DISTINCT qid FROM sub_truth) t LEFT JOIN (SELECT qid, count(DISTINCT vec_id) AS n FROM found WHERE (qid, vec_id) IN (SELECT (qid, vec_id) FROM sub_truth) GROUP BY 1) h ON t.qid = h.qid) a JOIN (SELECT t.qid AS qid, round(least(1.0::DOUBLE, CAST(coalesce(got, 0) AS DOUBLE) / best), 9) AS ratio FROM (SELECT qid, sum(ip) AS best FROM sub_truth GROUP BY 1) t LEFT JOIN (SELECT qid, sum(ip) AS got FROM found GROUP BY 1) f ON t.qid = f.qid) b ON a.qid = b.qid",
    "baseline_benchmark": averages("base_found", "base_cut"),
    "inverted_benchmark": averages("inv_found", "inv_cut"),
    "doc_freq": "SELECT * FROM doc_df",
    "idf_weights": "SELECT * FROM doc_w",
    "idf_full_universe": "SELECT * FROM custf_w",
    "length_stats": "SELECT CAST(min(l) AS BIGINT) AS min_l, CAST(max(l) AS BIGINT) AS max_l, round(avg(l), 9) AS avg_l, CAST(sum(l) AS BIGINT) AS total_l, count(*) AS n_dims FROM doc_w",
    "fixed_layout": "SELECT * FROM doc_fix",
    "sketch_slots": "SELECT * FROM emb_slots",
    "dim_limited_sketch": "SELECT * FROM emb_lim_slots",
    "sketch_sizes": "SELECT vec_id, count(*) AS size FROM doc_slots GROUP BY 1",
    "fixed_sketch_sizes": "SELECT vec_id, count(*) AS size FROM doc_fslots GROUP BY 1",
    "minhash_signatures": "SELECT * FROM km_sig",
    "minhash_signatures_arrow": "SELECT * FROM km_sig",
    "doc_signatures": "SELECT * FROM doc_sig",
    "bucket_sizes": "SELECT cluster_id, h, mh, count(*) AS n FROM km_sig GROUP BY 1, 2, 3",
    "inverted_set_index": "SELECT slot, vec_id FROM emb_fslots",
    "collision_counts": "SELECT qid, vec_id, cc FROM base_met",
    "overlap_estimates": "SELECT * FROM base_over",
    "kmeans_assign": f"SELECT * FROM {_A}",
    "kmeans_centroids": f"SELECT * FROM {_C}",
    "centroid_shift": f"SELECT coalesce(a.cluster_id, b.cluster_id) AS cluster_id, round(sqrt(CAST(sum((coalesce(a.w, 0) - coalesce(b.w, 0)) * (coalesce(a.w, 0) - coalesce(b.w, 0))) AS DOUBLE)) / {PPM}, 6) AS shift FROM km_c1 a FULL JOIN km_c2 b ON a.cluster_id = b.cluster_id AND a.dim = b.dim GROUP BY 1",
    "centroid_scores": "SELECT * FROM km_scores",
    "boundary_spill": "SELECT * FROM km_spill",
    "memberships": "SELECT * FROM km_members",
    "cluster_sizes": "SELECT * FROM km_sizes",
    "cluster_size_stats": "SELECT min(n_i) AS min_n, max(n_i) AS max_n, round(avg(n_i), 9) AS avg_n, count(*) AS n_clusters FROM km_sizes",
    "cluster_params": "SELECT * FROM km_params",
    "uniform_params": f"SELECT cluster_id, n_i, {q.M0} AS m_i, CAST(greatest({5 * q.K_EMB}, ceil(round({q.ETA}::DOUBLE * n + {q.K_EMB}, 9))) AS INTEGER) AS t_budget FROM km_sizes, km_n",
    "active_dims": "SELECT cluster_id, count(*) AS n_dims, round(avg(l), 9) AS avg_l FROM (SELECT DISTINCT cluster_id, dim FROM emb_vec JOIN km_members USING (vec_id)) d JOIN emb_w USING (dim) GROUP BY 1",
    "route_clusters": "SELECT qid, cluster_id, centroid_score, rank FROM route",
    "clustered_candidates": "SELECT * FROM cands",
    "clustered_topk": "SELECT * FROM found",
    "clustered_topk_nodedup": "SELECT * FROM found_rows",
    "verified_counts": "SELECT * FROM costs",
    "proxy_candidates": "SELECT * FROM proxy",
    "baseline_topk": "SELECT * FROM base_found",
    "raw_collision_topk": verified(cut("base_met", "cc DESC", q.K_EMB + q.UB), q.K_EMB),
    "inverted_scores": "SELECT * FROM inv",
    "inverted_overlap_topk": "SELECT * FROM inv_found",
    "minhash_first_200": verified(cut("base_met", "first_h", 200), q.K_EMB),
    "banded_topk": verified(cut("bands_met", "cc DESC", 200 + q.K_EMB), q.K_EMB),
    "recall_at_k": "SELECT * FROM recalls",
    "recall_by_rows": recall("found_rows", "count(*)"),
    "score_ratio": "SELECT * FROM ratios",
    "rank_ratio": "SELECT qid, round(CAST(sum(CAST(round(ratio * 1e9) AS BIGINT)) AS DOUBLE) / count(*) / 1e9, 6) AS mean_ratio, arg_max(ratio, rank) AS kth_ratio FROM aligned GROUP BY 1",
    "satisfied_at_c": f"SELECT CAST(c AS DOUBLE) AS c, round(CAST(count(CASE WHEN ratio >= c THEN 1 END) AS DOUBLE) / ((SELECT count(DISTINCT qid) FROM emb_truth) * {q.K_EMB}), 9) AS satisfied FROM aligned, (VALUES (0.8::DOUBLE), (0.85::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) l(c) GROUP BY 1",
    "coverage_precision": "SELECT * FROM coverage_t",
    "weighted_dots": f"SELECT qid, vec_id, CAST(sum(a.val * c * b.val) AS BIGINT) AS wip FROM emb_q a JOIN (SELECT dim, CAST(round((idf_ppm / {PPM}.0::DOUBLE) * (idf_ppm / {PPM}.0::DOUBLE) * (idf_ppm / {PPM}.0::DOUBLE) * {PPM}) AS BIGINT) AS c FROM emb_w) w USING (dim) JOIN emb_vec b USING (dim) GROUP BY 1, 2",
    "spearman_proxy": "SELECT * FROM spear",
    "proxy_summary": f"SELECT 'clustered' AS config, cut, {mean6('spearman')} AS spearman, {mean6('coverage')} AS coverage, {mean6('precision')} AS precision, count(*) AS n FROM coverage_t JOIN spear USING (qid) GROUP BY 2",
    "audit_status": f"SELECT *, CASE WHEN avg_recall >= 0.87 AND min_recall >= 0.8 THEN 'verified' WHEN avg_recall >= 0.82 THEN 'provisional' ELSE 'reject' END AS status FROM (SELECT {mean6('recall')} AS avg_recall, min(recall) AS min_recall, max(recall) AS max_recall FROM recalls) r",
    "spot_audit": "SELECT t.qid AS qid, truth_top, coalesce(result_top, '') AS result_top, recall, coalesce(n_verified, 0) AS n_verified FROM (SELECT qid, string_agg(CAST(vec_id AS VARCHAR), ';' ORDER BY rank) AS truth_top FROM emb_truth WHERE rank <= 10 GROUP BY 1) t LEFT JOIN (SELECT qid, string_agg(CAST(vec_id AS VARCHAR), ';' ORDER BY rank) AS result_top FROM found WHERE rank <= 10 GROUP BY 1) f ON t.qid = f.qid JOIN recalls r ON t.qid = r.qid LEFT JOIN costs c ON t.qid = c.qid",
    "consistency_check": "SELECT (SELECT count(DISTINCT qid) FROM found) AS n_a, (SELECT count(DISTINCT qid) FROM base_found) AS n_b, (SELECT count(DISTINCT qid) FROM emb_truth) AS n_truth, (SELECT count(*) FROM (SELECT qid FROM found INTERSECT SELECT qid FROM base_found INTERSECT SELECT qid FROM emb_truth) i) AS n_common, (SELECT CAST(max(rank) AS BIGINT) FROM (SELECT rank FROM found UNION ALL SELECT rank FROM base_found) u) AS depth",
    "benchmark_averages": f"SELECT count(*) AS n_queries, {mean6('recall')} AS recall, {mean6('ratio')} AS ratio, {mean6('coalesce(n_verified, 0)')} AS avg_verified FROM recalls JOIN ratios USING (qid) LEFT JOIN costs USING (qid)",
    "dedup_best_qps": first("curve", "dataset, method, config", "qps DESC, knob", _CURVE),
    "select_max_qps": "SELECT * FROM max_qps",
    "select_nearest": f"SELECT {_ROW}, CASE WHEN gap <= 0.01 THEN 'ok' ELSE 'N/A' END AS status FROM ({first('(SELECT *, round(abs(recall - target), 9) AS gap FROM wide) g', 'dataset, method, target', 'gap, qps DESC, config, knob')}) n",
    "select_reaching": first("(SELECT * FROM wide WHERE recall >= target) y", "dataset, method, target", "recall, qps DESC, config, knob", _ROW),
    "select_min_nprobe": first("(SELECT * FROM curve WHERE recall >= 0.95) y", "dataset, method, config", "knob, qps DESC", _CURVE),
    "pick_working_points": "SELECT * FROM points",
    "parameter_roles": "SELECT c.*, coalesce(role, 'rejected') AS role FROM curve c LEFT JOIN (SELECT dataset, method, config, knob, string_agg(role, '+' ORDER BY role) AS role FROM points GROUP BY 1, 2, 3, 4) p ON c.dataset = p.dataset AND c.method = p.method AND c.config = p.config AND c.knob = p.knob",
    "equal_recall_pivot": pivot("qps"),
    "paper_table": pivot("CAST(CAST(round(qps) AS BIGINT) AS VARCHAR) || ' (' || CAST(cost AS VARCHAR) || ')'", "'N/A'"),
    "speedups": "SELECT m.dataset AS dataset, m.method AS method, m.target AS target, m.qps AS qps, round(m.qps / b.qps, 6) AS speedup FROM max_qps m LEFT JOIN (SELECT * FROM max_qps WHERE method = 'm0') b ON m.dataset = b.dataset AND m.target = b.target",
    "monotonic_check": "SELECT dataset, method, bool_and(a) AS qps_ok, bool_and(b) AS cost_ok FROM (SELECT dataset, method, coalesce(qps <= lag(qps) OVER w, true) AS a, coalesce(cost >= lag(cost) OVER w, true) AS b FROM max_qps WHERE qps IS NOT NULL WINDOW w AS (PARTITION BY dataset, method ORDER BY target)) x GROUP BY 1, 2",
    "delta_vs_first": "SELECT dataset, knob, cost, cost - first_value(cost) OVER (PARTITION BY dataset ORDER BY knob) AS delta FROM curve",
    "index_bytes": f"SELECT {_SIZE} FROM ({size_row(0, 'x', 'km_sig', _CENTROID_BYTES)}) s",
    "space_decomposition": f"SELECT *, total_bytes - first_value(total_bytes) OVER (ORDER BY config_no) AS delta FROM ({size_row(0, 'global', 'emb_fsig', '0')} UNION ALL {size_row(1, 'clustered, no spill', 'unspilled', _CENTROID_BYTES)} UNION ALL {size_row(2, 'clustered, spill', 'km_sig', _CENTROID_BYTES)}) s",
    "dense_distances": "SELECT a.vec_id AS vec_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 6) AS ip, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS l2sq, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2]))), 6) AS l1, round(list_max(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2]))), 6) AS linf FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON a.vec_id + 1 = b.vec_id",
    "bit_distances": "SELECT o_orderkey, CAST(bit_count(k) + bit_count(c) AS BIGINT) AS ones, CAST(bit_count(k & c) + bit_count(c & m) AS BIGINT) AS n_and, CAST(bit_count(k | c) + bit_count(c | m) AS BIGINT) AS n_or, CAST(bit_count(xor(k, c)) + bit_count(xor(c, m)) AS BIGINT) AS n_xor, round(CASE WHEN bit_count(k | c) + bit_count(c | m) = 0 THEN 1.0::DOUBLE ELSE CAST(bit_count(k | c) + bit_count(c | m) - bit_count(k & c) - bit_count(c & m) AS DOUBLE) / (bit_count(k | c) + bit_count(c | m)) END, 9) AS jaccard FROM (SELECT o_orderkey, o_orderkey AS k, o_custkey AS c, o_orderkey % 1000 AS m FROM orders) o",
    "csr_roundtrip": "SELECT * FROM cust_vec",
    "common_queries": "SELECT DISTINCT qid FROM found INTERSECT SELECT qid FROM emb_truth",
    "method_curves": " UNION ALL ".join(f"SELECT '{n}' AS method, qid, recall FROM ({recall(t)}) r{i}" for i, (n, t) in enumerate((("clustered", "found"), ("baseline", "base_found"), ("inverted", "inv_found")))),
}


def compose(final: str) -> str:
    """The final text under the expressions that it needs, each after those that it needs itself."""
    order: list[str] = []

    def need(text: str) -> None:
        for word in re.findall(r"[a-z_0-9]+", text):
            if word in CTES and word not in order:
                need(CTES[word])
                if word not in order:
                    order.append(word)

    need(final)
    return ("WITH " + ",\n".join(f"{x} AS MATERIALIZED ({CTES[x]})" for x in order) + "\n" if order else "") + final


ORACLES = {name: compose(text) for name, text in FINAL.items()}
