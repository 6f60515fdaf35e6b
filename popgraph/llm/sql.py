"""SQL that checks the operators it can express, over the registered tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


def _split(value: str) -> str:
    return rf"list_filter(regexp_split_to_array({value}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


_TERMS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATE = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_low('text')}, {_TERMS}) AS w FROM benchmark WHERE item_id IS NOT NULL),
c AS (SELECT item, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
e AS (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM c),
pat AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM e),
d AS (SELECT doc_id, regexp_extract_all({_low('text')}, {_TERMS}) AS w FROM documents),
f AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m),
hit AS (SELECT f.doc_id, f.i, f.m, pat.item FROM f JOIN pat ON pat.m = f.m AND pat.p = array_to_string(f.w[f.i:f.i + f.m - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

JACCARD = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_split(_low('text'))} AS w FROM documents),
e AS (SELECT doc_id, w, least(3, len(w)) AS m, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + m - 1], ' ') AS g FROM e),
n AS MATERIALIZED (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * p.c >= 90 * (a.c + b.c - p.c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, g.low AS component_id, g.low = d.doc_id AS is_first
FROM d JOIN (SELECT x, min(y) AS low FROM r GROUP BY x) g ON g.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

LINES = rf"""
WITH e AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
f AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM e),
t AS (SELECT doc_id, i, list_transform({_split('line')}, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM f),
l AS MATERIALIZED (SELECT doc_id, i, t, len(t) || ' ' || array_to_string(t[1:4], ' ') AS leaf FROM t WHERE len(t) >= 4),
h AS MATERIALIZED (SELECT * FROM l WHERE leaf IN (SELECT leaf FROM l GROUP BY leaf HAVING count(*) >= 10)),
k AS (SELECT doc_id, i, leaf, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS token FROM h),
c AS MATERIALIZED (SELECT leaf, pos, token FROM k WHERE token <> '<*>' GROUP BY leaf, pos, token HAVING count(*) >= 10),
g AS (SELECT k.doc_id, k.i, k.leaf, string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY k.pos) AS template, count(c.token) AS fixed, count(*) AS n
  FROM k LEFT JOIN c ON c.leaf = k.leaf AND c.pos = k.pos AND c.token = k.token GROUP BY k.doc_id, k.i, k.leaf),
o AS MATERIALIZED (SELECT * FROM g WHERE fixed >= 0.5 * n),
q AS (SELECT leaf, template, min(doc_id) AS first FROM o GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= 10),
x AS MATERIALIZED (SELECT o.doc_id, o.i FROM o JOIN q ON q.leaf = o.leaf AND q.template = o.template WHERE o.doc_id <> q.first),
z AS (SELECT f.doc_id, count(*) AS n_lines, count(x.i) AS n_dropped, coalesce(string_agg(CASE WHEN x.i IS NULL THEN f.line END, chr(10) ORDER BY f.i), '') AS text
  FROM f LEFT JOIN x ON x.doc_id = f.doc_id AND x.i = f.i GROUP BY f.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, z.text FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id"""

SUFFIX = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM d WHERE len(h) >= 400),
m AS MATERIALIZED (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 400)) AS s FROM w),
r AS MATERIALIZED (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS after
  FROM m WHERE s IN (SELECT s FROM m GROUP BY s HAVING count(*) > 1)),
n AS (SELECT doc_id, sum(least(200, coalesce(after - p, 200))) AS n_removed, count(*) FILTER (before IS NULL OR p - before > 200) AS n_spans FROM r GROUP BY doc_id),
a AS (SELECT doc_id, CASE WHEN before IS NULL THEN 0 ELSE before + 200 END AS start, p AS stop FROM r WHERE before IS NULL OR p - before > 200
  UNION ALL SELECT doc_id, max(p) + 200, 1000000000 FROM r GROUP BY doc_id),
k AS (SELECT a.doc_id, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start) AS rest FROM a JOIN d ON d.doc_id = a.doc_id GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k.rest, d.h))) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""

# Every anchor against every row.
NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10
"""
