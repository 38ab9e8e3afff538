"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_ann"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.e, q.e) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

ORACLE_SQL["op3_ngram_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
tokens AS (SELECT doc_id, unnest(s) AS t FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT u AS node, u AS seen FROM ways UNION SELECT r.node, w.v FROM reach r JOIN ways w ON w.u = r.seen),
least_ AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, s.n AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id FROM sizes s LEFT JOIN least_ l ON l.node = s.doc_id"""

_RECORD = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce({h}, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce({h}, '') || chr(13) || chr(10) || chr(13) || chr(10)"
ORACLE_SQL["op5_fixity"] = f"""
WITH kept AS (SELECT page_id, coalesce(page_id // 1024, -1) AS file, {_RECORD.format(h="html")} AS r, {_RECORD.format(h="CASE WHEN page_id % 97 = 5 THEN substr(html, 1, length(html) - 1) ELSE html END")} AS c FROM pages),
rows AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY page_id) - 1 AS ordinal, sha256(r) AS expected, sha256(c) AS found, strlen(r) AS n,
  sum(strlen(r)) OVER (PARTITION BY file ORDER BY page_id) AS upto FROM kept)
SELECT file, ordinal, expected, found, CAST(upto - n AS BIGINT) AS first_offset, CAST(upto AS BIGINT) AS end_offset FROM rows WHERE expected <> found"""

_SHOWN = "'<|' || {t}.role || '|>' || chr(10) || {t}.text || '<|end|>' || chr(10)"
_TEXT = "coalesce(array_to_string(list_transform({l}, lambda t: " + _SHOWN.format(t="t") + "), ''), '')"
_MASK = "coalesce(array_to_string(list_filter(list_transform(range(1, len({l}) + 1), lambda i: CASE WHEN {l}[i].role = 'assistant' THEN (coalesce(list_sum(list_transform({l}[1:i - 1], lambda u: length(" + _SHOWN.format(t="u") + "))), 0) + 14)::BIGINT || ':' || (coalesce(list_sum(list_transform({l}[1:i - 1], lambda u: length(" + _SHOWN.format(t="u") + "))), 0) + 21 + length({l}[i].text))::BIGINT END), lambda x: x IS NOT NULL), ','), '')"
ORACLE_SQL["op10_preference"] = f"""
WITH turns AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn, role, text) AS l FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id),
spoken AS (SELECT conv_id, l, list_filter(range(1, len(l) + 1), lambda i: l[i].role = 'assistant') AS s FROM turns),
ends AS (SELECT conv_id, l[1:s[-1]] AS l, s[conv_id % len(s) + 1] AS p, l[s[-1]] AS reply FROM spoken WHERE len(s) > 0),
next_ AS (SELECT *, l[p] AS a, coalesce(lead(reply) OVER (ORDER BY conv_id), first(reply) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b FROM ends),
parts AS (SELECT conv_id AS pair_id, CASE WHEN a = b THEN len(l) ELSE p - 1 END AS k, l, l[1:p - 1] || [b] || l[p + 1:] AS r FROM next_),
rests AS (SELECT pair_id, k, l[1:k] AS prefix, l[k + 1:] AS c, r[k + 1:] AS r FROM parts)
SELECT pair_id, CAST(k AS INTEGER) AS prefix_turns, {_TEXT.format(l="prefix")} AS prompt, {_TEXT.format(l="c")} AS chosen, {_TEXT.format(l="r")} AS rejected,
  {_MASK.format(l="c")} AS chosen_mask, {_MASK.format(l="r")} AS rejected_mask FROM rests"""

# Words in lower case, sets of two-word shingles, all common shingles counted.
ORACLE_SQL["op12_minhash"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [hash(w[1])] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: hash(w[i] || ' ' || w[i + 1]))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (x + y - c)),
ways AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT u AS node, u AS seen FROM ways UNION SELECT r.node, w.v FROM reach r JOIN ways w ON w.u = r.seen),
least_ AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, s.n AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(l.component_id, s.doc_id) AS kept FROM sizes s LEFT JOIN least_ l ON l.node = s.doc_id"""

ORACLE_SQL["op13_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, v.vec_id, v.label, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE label = own),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3"""
