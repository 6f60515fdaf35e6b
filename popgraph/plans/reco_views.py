"""SQL sub-queries of the recommender: split, profile, providers, pool, features, reranked lists."""

from popgraph.operators.features import WEIGHTS
from popgraph.plans.registry import view

view("q_int", """
SELECT uuid, item, CASE WHEN pos <= n_val THEN 'validation' WHEN pos <= n_hold THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, CASE WHEN n >= 3 THEN least(v, least(n - 1, v + t)) WHEN n = 2 THEN 1 ELSE 0 END AS n_val,
    CASE WHEN n >= 3 THEN least(n - 1, v + t) WHEN n = 2 THEN 1 ELSE 0 END AS n_hold
  FROM (SELECT *, greatest(1, round_even(n * 0.1::DOUBLE, 0)) AS v, greatest(1, round_even(n * 0.1::DOUBLE, 0)) AS t FROM (
    SELECT uuid, item, row_number() OVER (PARTITION BY uuid ORDER BY md5(concat_ws(':', uuid, item, '42'))) AS pos, count(*) OVER (PARTITION BY uuid) AS n FROM q_hob)))""")
view("q_train", "SELECT uuid, item FROM q_int WHERE split = 'train'")
view("q_val", "SELECT uuid, item FROM q_int WHERE split = 'validation'")
view("q_test", "SELECT uuid, item FROM q_int WHERE split = 'test'")
view("q_people", "SELECT DISTINCT uuid FROM q_hob")
view("q_pop", "SELECT item, count(*) AS pop FROM q_train GROUP BY item")
view("q_rank", "SELECT item, pop, row_number() OVER (ORDER BY pop DESC, item) AS pop_rank FROM q_pop")
view("q_cooc", "SELECT a.item AS src, b.item AS dst, count(*) AS c FROM q_train a JOIN q_train b ON a.uuid = b.uuid AND a.item <> b.item GROUP BY a.item, b.item")
_FIELDS = ["age_group", "sex", "occupation", "district", "province", "family_type", "housing_type", "education_level"]
view("q_fields", " UNION ALL ".join(f"SELECT uuid, '{f}' AS field, {f} AS value FROM q_persons WHERE {f} <> ''" for f in _FIELDS))
view("q_hist", """SELECT item, field, value, count(*) AS cnt, count(*) / sum(count(*)) OVER (PARTITION BY item, field) AS share
FROM q_train t JOIN q_fields f ON f.uuid = t.uuid GROUP BY item, field, value""")
view("q_top20", "SELECT src, dst, c, rn FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) AS rn FROM q_cooc) WHERE rn <= 20")

_N = "(SELECT count(DISTINCT uuid) FROM q_train)"
WEIGHT_SQL = {
    "cooccurrence": "CAST(c AS DOUBLE)",
    "bm25": f"ln(({_N} - ds + 0.5::DOUBLE) / (ds + 0.5::DOUBLE) + 1) * (c * 2.2::DOUBLE) / (c + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (dd / (SELECT avg(pop) FROM q_pop))))",
    "idf_cooccurrence": f"c * ln(({_N} + 1)::DOUBLE / (1 + dd))",
    "pop_capped": "c / ln(1.0::DOUBLE + dd)",
    "jaccard": "c / (ds + dd - c)",
    "pmi": f"greatest(0.0::DOUBLE, ln((c / {_N}) / ((ds / {_N}) * (dd / {_N}))))",
}
for _kind, _expr in WEIGHT_SQL.items():
    view(f"q_w_{_kind}", f"SELECT src, dst, {_expr} AS w FROM (SELECT src, dst, c, a.pop AS ds, b.pop AS dd FROM q_cooc JOIN q_pop a ON a.item = src JOIN q_pop b ON b.item = dst)")
    view(f"q_c_{_kind}", f"""SELECT uuid, item, '{_kind}' AS provider, CAST(raw_score AS DOUBLE) AS raw_score FROM (
  SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY raw_score DESC, item) AS rn FROM (
    SELECT k.uuid, dst AS item, round(sum(w), 9) AS raw_score FROM q_train k JOIN q_w_{_kind} ON src = k.item GROUP BY k.uuid, dst) s
  WHERE NOT EXISTS (SELECT 1 FROM q_train t WHERE t.uuid = s.uuid AND t.item = s.item)) WHERE rn <= 50""")
view("q_c_popularity", """SELECT uuid, item, 'popularity' AS provider, CAST(pop AS DOUBLE) AS raw_score FROM (
  SELECT p.uuid, r.item, pop, row_number() OVER (PARTITION BY p.uuid ORDER BY pop_rank) AS rn FROM q_people p, q_rank r
  WHERE NOT EXISTS (SELECT 1 FROM q_train t WHERE t.uuid = p.uuid AND t.item = r.item)) WHERE rn <= 50""")
view("q_c_segment_popularity", """SELECT uuid, item, 'segment_popularity' AS provider, raw_score FROM (
  SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY raw_score DESC, item) AS rn FROM (
    SELECT p.uuid, r.item, round(COALESCE(s.s, 0) + pop * 1e-6, 9) AS raw_score FROM q_people p CROSS JOIN q_pop r LEFT JOIN
      (SELECT f.uuid, h.item, sum(share) AS s FROM q_fields f JOIN q_hist h ON h.field = f.field AND h.value = f.value WHERE f.field <> 'sex' GROUP BY f.uuid, h.item) s
      ON s.uuid = p.uuid AND s.item = r.item) x
  WHERE NOT EXISTS (SELECT 1 FROM q_train t WHERE t.uuid = x.uuid AND t.item = x.item)) WHERE rn <= 50""")
ORACLE_PROVIDERS = ["popularity", "cooccurrence", "segment_popularity", "bm25", "idf_cooccurrence", "pop_capped", "jaccard", "pmi"]


def normalized(source: str) -> str:
    return f"""SELECT *, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 1 - (rnk - 1)::DOUBLE / (n - 1) END AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY uuid, provider ORDER BY raw_score DESC, item) AS rnk, count(*) OVER (PARTITION BY uuid, provider) AS n FROM ({source}))"""


def merged(source: str, order: list[str], k: int = 50) -> str:
    """Merged candidates of a normalised set; `order` breaks ties between providers."""
    pos = "CASE provider " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(order)) + " ELSE 999 END"
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY score DESC, ord, item) AS rnk FROM (
  SELECT uuid, item, provider, score, raw_score, ord, n_sources FROM (
    SELECT uuid, item, provider, score, raw_score, {pos} AS ord, count(*) OVER (PARTITION BY uuid, item) AS n_sources,
      row_number() OVER (PARTITION BY uuid, item ORDER BY score DESC, {pos}) AS b FROM ({source})) WHERE b = 1)) WHERE rnk <= {k}"""


view("q_norm", normalized("SELECT * FROM q_c_popularity UNION ALL SELECT * FROM q_c_cooccurrence"))
view("q_pool", f"""SELECT m.*, p.score AS s_pop, c.score AS s_cooc FROM ({merged('SELECT * FROM q_norm', ['popularity', 'cooccurrence'])}) m
LEFT JOIN q_norm p ON p.uuid = m.uuid AND p.item = m.item AND p.provider = 'popularity'
LEFT JOIN q_norm c ON c.uuid = m.uuid AND c.item = m.item AND c.provider = 'cooccurrence'""")


def _fit(field):
    return f"COALESCE((SELECT share FROM q_hist h WHERE h.item = x.item AND h.field = '{field}' AND h.value = x.{field}), 0)"


def features_sql(source: str) -> str:
    """Feature columns of rows (uuid, item, s_pop, s_cooc)."""
    fits = ", ".join(f"COALESCE(h_{f}.share, 0) AS f_{f}" for f in ("age_group", "occupation", "province", "district", "sex"))
    joins = " ".join(
        f"LEFT JOIN q_hist h_{f} ON h_{f}.item = x.item AND h_{f}.field = '{f}' AND h_{f}.value = p.{f}"
        for f in ("age_group", "occupation", "province", "district", "sex"))
    miss = " + ".join(f"CASE WHEN pop IS NOT NULL AND f_{f} < 0.05 THEN 1 - f_{f} ELSE 0 END" for f in ("age_group", "occupation", "sex"))
    return f"""SELECT uuid, item, s_pop, s_cooc, 0.0::DOUBLE AS lightgcn_score, COALESCE(s_cooc, 0) AS cooccurrence_score, 0.0::DOUBLE AS segment_popularity_score,
  0.0::DOUBLE AS similar_person_score, 0.0::DOUBLE AS persona_text_fit, COALESCE(matched / total, 0) AS known_hobby_compatibility,
  f_age_group AS age_group_fit, f_occupation AS occupation_fit, greatest(f_province, f_district) AS region_fit,
  COALESCE(pop, 0) / max_pop AS popularity_prior, ({miss}) / 3 AS mismatch_penalty, ln(1 + COALESCE(pop, 0)) / ln(1 + max_pop) AS popularity_penalty,
  1 - ln(1 + COALESCE(pop, 0)) / ln(1 + max_pop) AS novelty_bonus, 0.0::DOUBLE AS category_diversity_reward,
  CASE WHEN n_known <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_cold_start,
  CASE WHEN s_pop IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS source_is_popularity, CASE WHEN s_cooc IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS source_is_cooccurrence,
  CASE WHEN s_pop IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN s_cooc IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS source_count, 0.0::DOUBLE AS text_embedding_similarity
FROM (SELECT x.uuid, x.item, x.s_pop, x.s_cooc, r.pop, (SELECT max(pop) FROM q_pop) AS max_pop, COALESCE(k.n, 0) AS n_known, c.total, m.matched, {fits}
  FROM ({source}) x JOIN q_persons p ON p.uuid = x.uuid LEFT JOIN q_pop r ON r.item = x.item
  LEFT JOIN (SELECT uuid, count(*) AS n FROM q_train GROUP BY uuid) k ON k.uuid = x.uuid
  LEFT JOIN (SELECT src, sum(c) AS total FROM q_top20 GROUP BY src) c ON c.src = x.item
  LEFT JOIN (SELECT t.uuid, q.src, sum(q.c) AS matched FROM q_top20 q JOIN q_train t ON t.item = q.dst GROUP BY t.uuid, q.src) m ON m.uuid = x.uuid AND m.src = x.item {joins})"""


view("q_feat", features_sql("SELECT uuid, item, s_pop, s_cooc FROM q_pool"))


def score_sql(weights=None):
    w = {**WEIGHTS, **(weights or {})}
    return " ".join(f"{'-' if n in ('mismatch_penalty', 'popularity_penalty') else '+'} {v}::DOUBLE * {n}" for n, v in w.items() if v)


view("q_rerank", f"SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY score DESC, item) AS rnk FROM (SELECT *, round(0 {score_sql()}, 9) AS score FROM q_feat)")
view("q_stage1", "SELECT uuid, item, score, rnk FROM q_pool")
view("q_items", "SELECT DISTINCT item, split_part(item, '/', 2) AS category FROM q_hob")


def summary_sql(truth: str, recs: str, ks=(5, 10, 20), categories: bool = False, pool: str | None = None) -> str:
    """Long-form metrics (metric, k, value) of a list source against a truth source."""
    base = f"""
tn AS (SELECT uuid, count(*) AS n FROM ({truth}) GROUP BY uuid),
re AS (SELECT r.uuid, r.item, r.rnk FROM ({recs}) r WHERE r.uuid IN (SELECT uuid FROM tn) AND rnk <= {max(ks)}),
hi AS (SELECT re.uuid, re.rnk FROM re JOIN ({truth}) t ON t.uuid = re.uuid AND t.item = re.item)"""
    parts = []
    for k in ks:
        parts.append(f"""SELECT unnest(['recall', 'hit_rate', 'ndcg']) AS metric, {k} AS k, unnest([avg(h / n), avg(CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),
  avg(d / list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i : 1 / log2(i + 1))))]) AS value FROM (
  SELECT tn.uuid, n, count(rnk) FILTER (rnk <= {k}) AS h, COALESCE(sum(1 / log2(rnk + 1)) FILTER (rnk <= {k}), 0) AS d FROM tn LEFT JOIN hi ON hi.uuid = tn.uuid GROUP BY tn.uuid, n)""")
        parts.append(f"SELECT 'catalog_coverage', {k}, count(DISTINCT item) FILTER (rnk <= {k}) / (SELECT count(*) FROM q_items) FROM re")
        parts.append(f"""SELECT 'novelty', {k}, avg(v) FROM (SELECT uuid, avg(-log2((COALESCE(pop, 0) + 1e-9) / (SELECT sum(pop) FROM q_pop)::DOUBLE)) AS v
  FROM re LEFT JOIN q_pop p ON p.item = re.item WHERE rnk <= {k} GROUP BY uuid)""")
        if categories:
            parts.append(f"""SELECT 'intra_list_diversity', {k}, avg(1 - s / (n * (n - 1))) FROM (SELECT uuid, sum(c) AS n, sum(c * (c - 1)) AS s FROM
  (SELECT uuid, category, count(*) AS c FROM re JOIN q_items i ON i.item = re.item WHERE rnk <= {k} GROUP BY uuid, category) GROUP BY uuid) WHERE n >= 2""")
        if pool:
            parts.append(f"""SELECT 'oracle_recall', {k}, avg(least(f, {k}) / n) FROM (SELECT tn.uuid, n, (SELECT count(*) FROM ({truth}) t JOIN ({pool}) p ON p.uuid = t.uuid AND p.item = t.item WHERE t.uuid = tn.uuid) AS f FROM tn)""")
    return f"WITH {base}\nSELECT metric, CAST(k AS INTEGER) AS k, round(value, 6) AS value FROM (" + "\nUNION ALL ".join(parts) + ")"
