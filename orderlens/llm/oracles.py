"""DuckDB SQL for the queries that SQL can express in seconds, over whole tables."""

from .license_scan import PHRASES, TEMPLATES

OP2 = r"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
usable AS (SELECT * FROM e WHERE label IS NOT NULL AND x IS NOT NULL
  AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS v, vec_id AS c FROM e UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.v),
g AS (SELECT v, min(c) AS component_id FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, g.component_id, e.vec_id = g.component_id AS kept
FROM e JOIN g ON g.v = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS k FROM n),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN least USING (k) WHERE doc_id > m),
r AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
b AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM b ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _rows(values: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in values)


OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
phrase AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {_rows(list(PHRASES.items()))}) v(p, label)),
place AS (SELECT r, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i : i + len(p) - 1] = p)) AS i FROM w, phrase),
base AS (SELECT r, count(*) AS n, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS labels
  FROM place GROUP BY r),
template AS (SELECT list_distinct(string_split(s, ' ')) AS s, label FROM (VALUES {_rows(TEMPLATES)}) v(label, s)),
lines AS (SELECT r, string_split(t, chr(10)) AS l FROM d),
blocks AS (SELECT r, unnest(list_transform(range(1, len(l) + 1), lambda i:
  regexp_extract_all(array_to_string(l[i : i + 2], ' '), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS b FROM lines),
held AS (SELECT r, label, len(list_intersect(list_distinct(b), s)) / len(s) AS c, len(s) AS n FROM blocks, template),
added AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS c FROM held WHERE c * n >= ceil(round(0.9 * n, 9)) GROUP BY r)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(added.labels, [])))), ',') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(added.c, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN added USING (r)
"""

OP12 = r"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same,
  CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT a, b, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

_ASSIGN = """
d{n} AS MATERIALIZED (SELECT vec_id, c, CAST(sum((x - v) * (x - v)) AS BIGINT) AS d FROM e JOIN c{n} USING (k) GROUP BY vec_id, c),
a{n} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY vec_id),"""
_MOVE = """
c{m} AS MATERIALIZED (SELECT c, k, coalesce((s - ((s % n) + n) % n) // n, v) AS v FROM c{n} LEFT JOIN
  (SELECT c, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN e USING (vec_id) GROUP BY c, k) USING (c, k)),"""

OP13 = """
WITH e AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS k,
  unnest(list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT))) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM e)),
c0 AS MATERIALIZED (SELECT c, k, x AS v FROM f JOIN e USING (vec_id) WHERE c < 8),""" + "".join(
    _ASSIGN.format(n=n) + _MOVE.format(n=n, m=n + 1) for n in range(10)) + _ASSIGN.format(n=10) + """
h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY k)) AS h FROM c10 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a10 JOIN h USING (c)
"""

ORACLES = {"op2_embedding_dedup": OP2, "op9_substring_dedup": OP9, "op11_license_scan": OP11, "op12_hard_negatives": OP12,
           "op13_centroids": OP13}
