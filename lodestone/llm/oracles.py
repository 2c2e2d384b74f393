"""DuckDB SQL that gives the rows of the queries that SQL can express at the size of whole tables."""

from __future__ import annotations

_MIX_UNIT = "((('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"

ORACLES: dict[str, str] = {
    "op2_preference": """
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(coalesce(role, 'unknown')), encode(coalesce(text, ''))) AS i FROM conversations),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS k FROM t WHERE role = 'assistant'),
l AS (SELECT conv_id, max(i) AS last, coalesce(max(CASE WHEN k = 2 THEN text END), '') AS prior FROM a GROUP BY conv_id),
s AS (SELECT t.conv_id, 'c' AS side, t.i AS i, role, text FROM t UNION ALL
  SELECT t.conv_id, 'r', t.i, role, CASE WHEN t.i = last THEN prior ELSE text END FROM t LEFT JOIN l ON t.conv_id IS NOT DISTINCT FROM l.conv_id),
d AS (SELECT c.conv_id, count(*) AS all_turns, min(CASE WHEN c.text <> r.text THEN c.i - 1 END) AS n FROM s c JOIN s r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.i = r.i AND c.side = 'c' AND r.side = 'r' GROUP BY c.conv_id),
p AS (SELECT s.*, coalesce(n, all_turns) AS n, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' AS body FROM s JOIN d ON s.conv_id IS NOT DISTINCT FROM d.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, side, i > n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM p)
SELECT conv_id AS pair_id, CAST(max(n) AS INTEGER) AS n_prompt_turns,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (side = 'c' AND i <= n), '') AS prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (side = 'c' AND i > n), '') AS chosen,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (side = 'r' AND i > n), '') AS rejected,
  coalesce(string_agg(start || ':' || (start + length(body)), ',' ORDER BY i) FILTER (side = 'c' AND i > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(start || ':' || (start + length(body)), ',' ORDER BY i) FILTER (side = 'r' AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY conv_id
""",
    "op4_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.x, d.x) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p) t WHERE r <= 20
""",
    "op8_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS t FROM (SELECT *, least(len(w), 10) AS l FROM b WHERE len(w) > 0) x, LATERAL (SELECT unnest(range(1, len(x.w) - x.l + 2)) AS i) y),
dw AS (SELECT rid, l, i, array_to_string(w[i:i + l - 1], ' ') AS t FROM d x, (SELECT DISTINCT l FROM bw) z, LATERAL (SELECT unnest(range(1, len(x.w) - z.l + 2)) AS i) y),
h AS (SELECT rid, i, dw.l AS l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.t = bw.t),
words AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM h x, LATERAL (SELECT unnest(range(0, x.l)) AS k) y GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h) q GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN its USING (rid)
""",
    "op10_mixing": rf"""
WITH q AS (SELECT CAST(doc_id AS BIGINT) AS qid, max(CAST(quality AS DOUBLE)) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, source IS NULL AS nul, coalesce(source, '') AS src, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  -ln({_MIX_UNIT}) / greatest(0.0625::DOUBLE, least(16.0::DOUBLE, 1 + coalesce(q, 0.0::DOUBLE))) AS k FROM documents LEFT JOIN q ON doc_id = qid),
s AS (SELECT nul, src, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY nul, encode(src)) AS i FROM d GROUP BY nul, src),
w AS (SELECT *, CAST((i - 1) % 3 + 1 AS DOUBLE) AS w, CAST(3 * s AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (CAST(sum(s) OVER () AS DOUBLE) - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lev FROM w WINDOW o AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(lev, (cap / w, i)) AS water FROM l WHERE lev <= cap / w),
t AS (SELECT nul, src, s, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * w) END AS target FROM l, f),
p AS (SELECT *, sum(size) OVER (PARTITION BY d.nul, d.src ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN t USING (nul, src)),
e AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS full_epochs FROM p)
SELECT doc_id, size, s AS source_size, target, CAST(size * (full_epochs + CASE WHEN size > 0 AND CAST(upto AS DOUBLE) - size / 2.0::DOUBLE < target - CAST(full_epochs * s AS DOUBLE) AND full_epochs < 3 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM e
""",
}
