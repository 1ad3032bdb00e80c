"""SQL that DuckDB runs for the operators whose results SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS s FROM w)),
least_doc AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN least_doc USING (h) WHERE d < doc_id),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

#: Components as the least node reachable, from a table `link` of both directions.
REACH = "reach AS (SELECT a AS node, b AS other FROM link UNION SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.other)"

OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
pair AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
link AS (SELECT x AS a, y AS b FROM pair UNION SELECT y, x FROM pair),
{REACH},
least_node AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, least(w.doc_id, coalesce(m, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_node ON node = w.doc_id
"""

OP4_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, s, hash(substr(h, 2 * s + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS s FROM b)),
many AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, s FROM win SEMI JOIN many USING (k)),
run AS (SELECT doc_id, s, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > 200, true) AS new FROM hit),
spans AS (SELECT doc_id, min(s) AS lo, max(s) + 200 AS hi FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM run) GROUP BY doc_id, g),
cuts AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM spans GROUP BY doc_id),
kept AS (SELECT b.doc_id, length(h) // 2 AS n, n_spans, n_removed, CASE WHEN los IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(los) + 1),
  lambda i: substr(h, 2 * coalesce(CASE WHEN i > 0 THEN his[i] END, 0) + 1, 2 * (coalesce(CASE WHEN i < len(los) THEN los[i + 1] END, length(h) // 2) - coalesce(CASE WHEN i > 0 THEN his[i] END, 0)))), '') END AS k
  FROM b LEFT JOIN cuts USING (doc_id))
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM kept
"""

OP10_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS q FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.q > 0 AND b.q > 0 AND list_inner_product(a.e, b.e) / sqrt(a.q) / sqrt(b.q) >= 0.93),
{REACH},
n AS (SELECT a, count(*) AS n FROM link GROUP BY a), least_node AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least_node ON node = vec_id
"""
