"""SQL for those registered queries that SQL can express.

Tokenizers, 64-bit XXH64 with a seed, trained models and all-pairs shingle sets can't be
expressed in bounded time; those queries are tested against brute force.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS s, w FROM w WHERE len(w) >= 35),
h AS (SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS k FROM g),
r AS (SELECT k FROM h GROUP BY k HAVING COUNT(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM h JOIN r USING (k)),
t AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
k AS (SELECT t.doc_id, COUNT(c.p) AS n_removed, string_agg(x, ' ' ORDER BY t.p) FILTER (WHERE c.p IS NULL) AS kept FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.p = t.p GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

_OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, least(10, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 8))) AS s, w FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM i),
z AS (SELECT DISTINCT n FROM g),
x AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d JOIN z ON len(w) >= n),
h AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM x),
m AS (SELECT doc_id, s, h.n, item_id FROM h JOIN g ON g.n = h.n AND g.k = h.k),
p AS (SELECT doc_id, COUNT(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM m) GROUP BY 1),
t AS (SELECT doc_id, COUNT(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, MIN(root) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, COUNT(*) AS n_links FROM l GROUP BY 1)
SELECT c.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

_OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT k, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term, COUNT(*) AS whole FROM o GROUP BY 1, 2 HAVING COUNT(DISTINCT k) >= 3),
c AS (SELECT lang, source, term, COUNT(*) AS n FROM o JOIN v USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, COUNT(*) AS v, SUM(whole) AS n FROM v GROUP BY 1),
t AS (SELECT lang, source, SUM(n) AS n FROM c GROUP BY 1, 2),
f AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, CAST(1 + (CAST(coalesce(c.n, 0) AS HUGEINT) + 1) * 1000000000 // (coalesce(t.n, 0) + l.v) AS HUGEINT) AS p, CAST(1 + (CAST(v.whole AS HUGEINT) + 1) * 1000000000 // (l.n + l.v) AS HUGEINT) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
s AS (SELECT a.lang, a.source, b.source AS item, SUM((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
p AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
x AS (SELECT * FROM p UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM f WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def _op13(rounds: int = 3) -> str:
    """Ball k-means gives what plain k-means gives, which SQL can write round by round."""
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        "x AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS i, unnest(e) AS x FROM v)",
        "s AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id, e) - 1 AS c, e FROM v ORDER BY c LIMIT 16)",
        "c0 AS MATERIALIZED (SELECT c, unnest(range(1, 65)) AS i, unnest(e) AS m FROM s)",
    ]
    for k in range(rounds + 1):
        parts.append(f"d{k} AS (SELECT r, c, SUM((x - m) * (x - m)) AS d FROM x JOIN c{k} USING (i) GROUP BY 1, 2)")
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS n FROM d{k}) WHERE n = 1)")
        if k < rounds:
            parts.append(f"m{k} AS (SELECT c, i, SUM(x) AS s, CAST(COUNT(*) AS HUGEINT) AS n FROM a{k} JOIN x USING (r) GROUP BY 1, 2)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c, i, CAST(CASE WHEN n IS NULL THEN m ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS m FROM c{k} LEFT JOIN m{k} USING (c, i))")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY 1)")
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(SUM(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(SUM(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN h USING (c)"


ORACLES: dict[str, str] = {"op4_substring_dedup": _OP4, "op7_decontamination": _OP7, "op9_embedding_near_dedup": _OP9, "op11_source_divergence": _OP11, "op13_centroid_clustering": _op13()}
