"""Interactions, candidates, merging, features, reranking, metrics, audit and explanation
(RD*, CP*, SC*, RF*, RR*, ME*, AU*, EX*, DV*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popgraph.functions.columns import row_count, shuffle_key, top_n, top_n_global
from popgraph.functions.vectors import lexical_similarity, vector_sums
from popgraph.operators import candidates as cand
from popgraph.operators import diversity, embedding, explain, features, interactions, metrics, ranker
from popgraph.operators import vocabulary as voc
from popgraph.operators.workspace import POOL_ORDER
from popgraph.plans import reco_views as rv
from popgraph.plans.registry import plan, view
from popgraph.session import cut_lineage
from popgraph.sources import files


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


def categories(t) -> DataFrame:
    return t.reco.split.select("item").distinct().withColumn("category", F.get(F.split("item", "/"), F.lit(1)))


# --- vocabulary and interactions ------------------------------------------------------------------

RULES = [
    {"canonical": "ring work", "include": ["ring"], "exclude": ["hot"], "category": "craft"},
    {"canonical": "gear work", "include": ["gear"], "exclude": [], "category": "machine"},
    {"canonical": "bolt work", "include": ["bolt", "nut"], "exclude": ["small"], "category": "machine"},
]
ALIASES = [("hot ring", "heated ring"), ("blue widget", "widget")]


def _aliases(t):
    return t.spark.createDataFrame(ALIASES, "raw string, canonical string")


view("q_rawhob", """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS uuid, CASE WHEN l_linenumber % 3 = 0 THEN upper(p_name)
  WHEN l_linenumber % 3 = 1 THEN ' ' || replace(p_name, ' ', '  ') ELSE p_name || ' ' || lower(p_type) END AS raw
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 45""")
view("q_names", "SELECT DISTINCT raw, lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS name FROM q_rawhob")
_RULE = ("CASE WHEN contains(name, 'ring') AND NOT contains(name, 'hot') THEN 'ring work' WHEN contains(name, 'gear') THEN 'gear work' "
         "WHEN (contains(name, 'bolt') OR contains(name, 'nut')) AND NOT contains(name, 'small') THEN 'bolt work' END")
_ALIAS = "CASE name WHEN 'hot ring' THEN 'heated ring' WHEN 'blue widget' THEN 'widget' END"
view("q_canon", f"SELECT raw, name, COALESCE({_ALIAS}, {_RULE}, name) AS canonical, CASE WHEN {_ALIAS} IS NOT NULL THEN 'alias' WHEN {_RULE} IS NOT NULL THEN 'rule' ELSE 'name' END AS how FROM q_names")
view("q_prep", "SELECT uuid, r.raw, canonical AS item FROM q_rawhob r JOIN q_canon c ON c.raw = r.raw")
view("q_prepd", "SELECT item, count(DISTINCT uuid) AS degree FROM q_prep GROUP BY item")
MIN_DEGREE = 60


def _prepared(t):
    return voc.prepare_edges(t.raw_hobbies, _aliases(t), RULES)


@plan("RD01_normalize_names", "SELECT raw, name FROM q_names")
def _(t):
    return voc.normalize_names(t.raw_hobbies, "raw", "name")


@plan("RD02_canonicalize", "SELECT raw, name, canonical, how FROM q_canon")
def _(t):
    return voc.canonical_names(voc.normalize_names(t.raw_hobbies, "raw", "name"), _aliases(t), RULES)


@plan("RD03_prepare_edges", "SELECT item, degree FROM q_prepd")
def _(t):
    return voc.degrees(_prepared(t))


@plan("RD04_rare_items", f"""SELECT 'drop' AS policy, count(*) AS edges, CAST(0 AS BIGINT) AS rare_edges FROM (SELECT DISTINCT uuid, item FROM q_prep) JOIN q_prepd USING (item) WHERE degree >= {MIN_DEGREE}
UNION ALL SELECT 'keep_with_fallback', count(*), count(*) FILTER (degree < {MIN_DEGREE}) FROM (SELECT DISTINCT uuid, item FROM q_prep) JOIN q_prepd USING (item)""")
def _(t):
    edges = _prepared(t)
    parts = [
        voc.apply_rare_policy(edges, MIN_DEGREE, p).agg(row_count("edges"), F.count_if("rare").alias("rare_edges")).withColumn("policy", F.lit(p))
        for p in ("drop", "keep_with_fallback")
    ]
    return parts[0].unionByName(parts[1])


@plan("RD05_observed_variants", """SELECT item, string_agg(raw, '|' ORDER BY raw) AS variants FROM (SELECT item, raw, row_number() OVER (PARTITION BY item ORDER BY raw) AS rn
  FROM (SELECT DISTINCT item, trim(raw) AS raw FROM q_prep)) WHERE rn <= 5 GROUP BY item""")
def _(t):
    return voc.observed_variants(_prepared(t)).select("item", F.array_join("variants", "|").alias("variants"))


@plan("RD06_retained_taxonomy", f"""SELECT canonical AS item, category FROM (VALUES ('ring work', 'craft'), ('gear work', 'machine'), ('bolt work', 'machine'), ('unknown', 'none')) v(canonical, category)
WHERE canonical IN (SELECT item FROM q_prepd WHERE degree >= {MIN_DEGREE})""")
def _(t):
    table = t.spark.createDataFrame([(r["canonical"], r["category"]) for r in RULES] + [("unknown", "none")], "item string, category string")
    return voc.retained_subset(table, voc.apply_rare_policy(_prepared(t), MIN_DEGREE, "drop"))


def _counter_sql(prefix, src, name, persons=True):
    sql = f"""SELECT unnest(['{prefix}_edges', '{prefix}_hobbies', '{prefix}_singleton_hobbies', '{prefix}_singleton_ratio']) AS metric,
  unnest([sum(n)::DOUBLE, count(*)::DOUBLE, (count(*) FILTER (n = 1))::DOUBLE, (count(*) FILTER (n = 1)) / count(*)]) AS value FROM (SELECT count(*) AS n FROM ({src}) GROUP BY {name})"""
    return sql + (f" UNION ALL SELECT '{prefix}_persons', count(DISTINCT uuid)::DOUBLE FROM ({src})" if persons else "")


_CAN, _RET = "SELECT DISTINCT uuid, item FROM q_prep", f"SELECT DISTINCT uuid, item FROM q_prep WHERE item IN (SELECT item FROM q_prepd WHERE degree >= {MIN_DEGREE})"
view("q_vocab", f"""{_counter_sql('raw', 'SELECT * FROM q_rawhob', 'raw', False)} UNION ALL {_counter_sql('canonical', _CAN, 'item')} UNION ALL {_counter_sql('retained', _RET, 'item')}
UNION ALL SELECT 'rare_items_count', count(*)::DOUBLE FROM q_prepd WHERE degree < {MIN_DEGREE} UNION ALL SELECT 'rare_edges_count', COALESCE(sum(degree), 0)::DOUBLE FROM q_prepd WHERE degree < {MIN_DEGREE}
UNION ALL SELECT 'dropped_edges', ((SELECT count(*) FROM ({_CAN})) - (SELECT count(*) FROM ({_RET})))::DOUBLE
UNION ALL SELECT 'dropped_hobbies', ((SELECT count(DISTINCT item) FROM ({_CAN})) - (SELECT count(DISTINCT item) FROM ({_RET})))::DOUBLE
UNION ALL SELECT 'dropped_persons', ((SELECT count(DISTINCT uuid) FROM ({_CAN})) - (SELECT count(DISTINCT uuid) FROM ({_RET})))::DOUBLE""")


def _vocab(t, edges):
    return voc.vocabulary_report(t.raw_hobbies, edges, voc.apply_rare_policy(edges, MIN_DEGREE, "drop"), MIN_DEGREE)


@plan("RD07_vocabulary_report", "SELECT metric, round(value, 6) AS value FROM q_vocab")
def _(t):
    return rounded(_vocab(t, _prepared(t)), "value")


@plan("RD08_coverage_gate", """
WITH plain AS (SELECT DISTINCT uuid, name FROM q_rawhob r JOIN q_names n ON n.raw = r.raw), b AS (SELECT * FROM (
  SELECT unnest(['canonical_edges', 'canonical_hobbies', 'canonical_singleton_ratio']) AS metric, unnest([sum(n)::DOUBLE, count(*)::DOUBLE, (count(*) FILTER (n = 1)) / count(*)]) AS value FROM (SELECT count(*) AS n FROM plain GROUP BY name)
  UNION ALL SELECT 'canonical_persons', count(DISTINCT uuid)::DOUBLE FROM plain))
SELECT b.metric, round(b.value, 6) AS baseline, round(v.value, 6) AS current,
  CASE WHEN b.metric IN ('canonical_edges', 'canonical_persons') THEN v.value >= b.value ELSE v.value < b.value END AS passed FROM b JOIN q_vocab v ON v.metric = b.metric""")
def _(t):
    none = t.spark.createDataFrame([], "raw string, canonical string")
    plain = voc.prepare_edges(t.raw_hobbies, none, [])
    return voc.coverage_gate(_vocab(t, plain), _vocab(t, _prepared(t)))


@plan("RD09_dense_ids", "SELECT uuid, item, dense_rank() OVER (ORDER BY uuid) - 1 AS person_id, dense_rank() OVER (ORDER BY item) - 1 AS item_id FROM q_hob")
def _(t):
    return interactions.index_edges(t.hobbies)


@plan("IO06_indexed_split_file", "SELECT split, count(*) AS cnt FROM q_int GROUP BY split")
def _(t):
    path = files.scratch_path(t.spark, "split")
    files.write_split(t.reco.split, path)
    return files.read_split(t.spark, path).groupBy("split").agg(row_count())


@plan("RD10_split", "SELECT uuid, item, split FROM q_int")
def _(t):
    return t.reco.split


@plan("RD11_known_sets", """SELECT uuid, count(*) FILTER (split = 'train') AS train_known, count(*) AS full_known, count(*) FILTER (split <> 'train') AS held_out FROM q_int GROUP BY uuid""")
def _(t):
    return t.reco.split.groupBy("uuid").agg(
        F.count_if(F.col("split") == "train").alias("train_known"), row_count("full_known"), F.count_if(F.col("split") != "train").alias("held_out")
    )


_HEX = "CAST('0x' || substr(md5({}), 1, 12) AS BIGINT)"
view("q_ids", "SELECT item, row_number() OVER (ORDER BY item) - 1 AS item_id FROM q_items")
view("q_neg", f"""
SELECT uuid, item, c.item AS negative FROM (
  SELECT p.uuid, p.item, i.item AS cand, i.item_id, row_number() OVER (PARTITION BY p.uuid, p.item ORDER BY i.item_id) - 1 AS pos,
    {_HEX.format("concat_ws(':', p.uuid, p.item, '42')")} % ((SELECT count(*) FROM q_ids) - (SELECT count(*) FROM q_hob h WHERE h.uuid = p.uuid)) AS r
  FROM q_train p JOIN q_ids i ON NOT EXISTS (SELECT 1 FROM q_hob h WHERE h.uuid = p.uuid AND h.item = i.item)) x JOIN q_ids c ON c.item = x.cand WHERE pos = r""".replace("SELECT uuid, item, c.item", "SELECT x.uuid, x.item, c.item"))


def _negatives(t):
    return interactions.sample_negative(t.reco.train, t.reco.split, t.hobbies, seed=42)


@plan("RD12_sample_negative", "SELECT uuid, item, negative FROM q_neg")
def _(t):
    return _negatives(t)


@plan("RD13_training_batches", """SELECT uuid, item, negative, pos, pos // 512 AS batch FROM (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', uuid, item, '43'))) - 1 AS pos FROM q_neg)""")
def _(t):
    return interactions.training_triples(_negatives(t), 512)


@plan("RD14_popularity", "SELECT item, pop FROM q_pop")
def _(t):
    return t.reco.pop


@plan("RD15_field_histogram", "SELECT item, field, value, cnt, round(share, 6) AS share FROM q_hist")
def _(t):
    return rounded(t.reco.histogram, "share")


@plan("RD16_top_cooccurring", "SELECT src, dst, c, CAST(rn AS INTEGER) AS rnk FROM q_top20")
def _(t):
    return interactions.top_cooccurring(t.reco.cooc)


@plan("RD17_train_only_guard", "SELECT 'train' AS split, count(*) AS rows, true AS accepted FROM q_train UNION ALL SELECT 'all', count(*), false FROM q_int")
def _(t):
    out = []
    for name, df in (("train", t.reco.split.where(F.col("split") == "train")), ("all", t.reco.split)):
        try:
            interactions.require_train_only(df)
            accepted = True
        except ValueError:
            accepted = False
        out.append(df.agg(row_count("rows")).select(F.lit(name).alias("split"), "rows", F.lit(accepted).alias("accepted")))
    return out[0].unionByName(out[1])


@plan("RD18_fallback_report", "SELECT count(DISTINCT uuid) FILTER (split <> 'train') AS evaluated_persons, count(DISTINCT uuid) AS persons FROM q_int")
def _(t):
    per = t.reco.split.groupBy("uuid").agg(F.bool_or(F.col("split") != "train").alias("held"))
    return per.agg(F.count_if("held").alias("evaluated_persons"), row_count("persons"))


# --- candidate providers --------------------------------------------------------------------------


@plan("CP01_popularity_counts", "SELECT item, pop, CAST(pop_rank AS INTEGER) AS pop_rank FROM q_rank")
def _(t):
    return cand.popularity_ranks(t.reco.pop)


@plan("CP03_cooccurrence_counts", "SELECT src, dst, c FROM q_cooc")
def _(t):
    return t.reco.cooc


_CAND = "SELECT uuid, item, provider, raw_score FROM q_c_{}"
for _key, _prov in [
    ("CP02_popularity", "popularity"), ("CP04_cooccurrence", "cooccurrence"), ("CP06_segment_popularity", "segment_popularity"),
    ("CP08_bm25", "bm25"), ("CP10_idf_cooccurrence", "idf_cooccurrence"), ("CP12_pop_capped", "pop_capped"), ("CP14_jaccard", "jaccard"), ("CP16_pmi", "pmi"),
]:
    def _provider(key=_key, prov=_prov):
        @plan(key, _CAND.format(prov))
        def _(t):
            return t.reco.provider(prov)
    _provider()

for _key, _kind in [("CP07_bm25_weights", "bm25"), ("CP09_idf_weights", "idf_cooccurrence"), ("CP11_pop_capped_weights", "pop_capped"), ("CP13_jaccard_weights", "jaccard"), ("CP15_pmi_weights", "pmi")]:
    def _weight(key=_key, kind=_kind):
        @plan(key, f"SELECT src, dst, round(w, 6) AS w FROM q_w_{kind}")
        def _(t):
            return rounded(t.reco.weights(kind), "w")
    _weight()

view("q_backfill", """SELECT uuid, item, rn AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY prio, raw_score DESC, item) AS rn FROM (
  SELECT uuid, item, prio, raw_score FROM (SELECT *, row_number() OVER (PARTITION BY uuid, item ORDER BY prio) AS b FROM (
    SELECT uuid, item, 0 AS prio, raw_score FROM q_c_cooccurrence UNION ALL SELECT uuid, item, 1, raw_score FROM q_c_popularity)) WHERE b = 1)) WHERE rn <= 20""")


def _backfill(t):
    return cand.with_backfill(t.reco.provider("cooccurrence"), t.reco.provider("popularity"), 20)


@plan("CP05_cooccurrence_backfill", "SELECT uuid, item, CAST(rnk AS INTEGER) AS rnk FROM q_backfill")
def _(t):
    return _backfill(t)


def _factors(t):
    """Vectors with a closed form: each item is its category one-hot plus popularity, a person the sum of its items."""
    items = embedding.category_vectors(categories(t), CATEGORIES)
    items = items.join(t.reco.pop, "item").select("item", F.concat("embedding", F.array(F.col("pop") / 1000.0)).alias("embedding"))
    people = vector_sums(t.reco.train.join(items, "item"), ["uuid"], "embedding", len(CATEGORIES) + 1)
    return people, items


CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
@plan("CP17_embedding_candidates", """SELECT uuid, item, round(s, 6) AS raw_score FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY s DESC, item) AS rn FROM
  (SELECT uuid, item, round(s, 9) AS s FROM q_dot) d WHERE NOT EXISTS (SELECT 1 FROM q_train t WHERE t.uuid = d.uuid AND t.item = d.item)) WHERE rn <= 20""")
def _(t):
    people, items = _factors(t)
    hits = cand.embedding_candidates(people, items, t.reco.train, 20)
    return rounded(hits, "raw_score").select("uuid", "item", "raw_score")


view("q_dot", """SELECT p.uuid, i.item, COALESCE(n.same, 0) + p.pop * i.pop / 1000.0::DOUBLE AS s FROM
  (SELECT uuid, sum(r.pop) / 1000.0::DOUBLE AS pop FROM q_train t JOIN q_pop r ON r.item = t.item GROUP BY uuid) p
  CROSS JOIN (SELECT r.item, r.pop, x.category FROM q_pop r JOIN q_items x ON x.item = r.item) i
  LEFT JOIN (SELECT t.uuid, x.category, count(*) AS same FROM q_train t JOIN q_items x ON x.item = t.item GROUP BY t.uuid, x.category) n
    ON n.uuid = p.uuid AND n.category = i.category""")


@plan("CP18_batch_factors_topk")
def _(t):
    people, items = ranker.factors(t.reco.train, rank_dim=16, iterations=5)
    return rounded(cand.embedding_candidates(people, items, t.reco.train, 10), "raw_score")


@plan("CP19_unknown_person_fallback", """SELECT uuid, item, 'popularity_fallback' AS provider, CAST(pop AS DOUBLE) AS raw_score FROM (SELECT CAST(doc_id + 1000000 AS VARCHAR) AS uuid FROM documents) r, q_rank WHERE pop_rank <= 10""")
def _(t):
    asked = t.raw("documents").select((F.col("doc_id") + 1000000).cast("string").alias("uuid"))
    known = t.hobbies.select("uuid").distinct()
    return cand.cold_requests(asked.unionByName(known), t.persons, t.reco.pop, 10)


def _n_items(t):
    return t.reco.split.select("item").distinct().count()


_SUM = {
    "popularity": "SELECT uuid, item, row_number() OVER (PARTITION BY uuid ORDER BY raw_score DESC, item) AS rnk FROM q_c_popularity",
    "backfill": "SELECT * FROM q_backfill",
}
_TRUTH = "SELECT uuid, item FROM q_val"


def _summary(t, recs, truth="validation", **kw):
    w = t.reco
    return rounded(metrics.summary(w.part(truth), recs, _n_items(t), w.pop, **kw), "value")


def _ranked(c):
    return c.withColumn("rnk", F.row_number().over(Window.partitionBy("uuid").orderBy(F.desc("raw_score"), F.asc("item"))))


@plan("CP20_baseline_metrics", " UNION ALL ".join(f"SELECT '{n}' AS baseline, * FROM ({rv.summary_sql(_TRUTH, r)})" for n, r in _SUM.items()))
def _(t):
    a = _summary(t, _ranked(t.reco.provider("popularity"))).withColumn("baseline", F.lit("popularity"))
    return a.unionByName(_summary(t, _backfill(t)).withColumn("baseline", F.lit("backfill")))


# --- normalisation and merging --------------------------------------------------------------------


@plan("SC01_rank_percentile", "SELECT uuid, item, provider, CAST(rnk AS INTEGER) AS rnk, round(score, 6) AS score FROM q_norm")
def _(t):
    return rounded(t.reco.normalized, "score").select("uuid", "item", "provider", "rnk", "score")


@plan("SC02_min_max", """SELECT uuid, item, provider, round(CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (raw_score - lo) / (hi - lo) END, 6) AS score FROM (
  SELECT *, min(raw_score) OVER (PARTITION BY uuid, provider) AS lo, max(raw_score) OVER (PARTITION BY uuid, provider) AS hi FROM q_norm)""")
def _(t):
    w = t.reco
    both = w.provider("popularity").unionByName(w.provider("cooccurrence"))
    return rounded(cand.normalize_scores(both, "min_max"), "score").select("uuid", "item", "provider", "score")


@plan("SC03_merge", "SELECT uuid, item, provider, round(score, 6) AS score, raw_score, CAST(n_sources AS INTEGER) AS n_sources, CAST(rnk AS INTEGER) AS rnk FROM q_pool")
def _(t):
    m = cand.merge(t.reco.normalized, 50, POOL_ORDER)
    return rounded(m, "score").select("uuid", "item", "provider", "score", "raw_score", F.size("source_scores").alias("n_sources"), "rnk")


@plan("SC04_flat_records", "SELECT uuid, item, provider, round(score, 6) AS score, round(COALESCE(s_pop, 0), 6) AS popularity, round(COALESCE(s_cooc, 0), 6) AS cooccurrence FROM q_pool")
def _(t):
    zero = F.lit(0.0)
    return t.reco.pool.select(
        "uuid", "item", "provider", F.round("score", 6).alias("score"),
        *[F.round(F.coalesce(F.try_element_at("source_scores", F.lit(p)), zero), 6).alias(p) for p in POOL_ORDER],
    )


@plan("SC05_contribution", """SELECT n.provider, raw_candidates, COALESCE(selected, 0) AS selected FROM (SELECT provider, count(*) AS raw_candidates FROM q_norm GROUP BY provider) n
LEFT JOIN (SELECT provider, count(*) AS selected FROM q_pool GROUP BY provider) p ON p.provider = n.provider""")
def _(t):
    return cand.contribution(t.reco.normalized, t.reco.pool)


@plan("SC06_candidate_pool", "SELECT uuid, item, CAST(rnk AS INTEGER) AS rnk FROM q_pool")
def _(t):
    return t.reco.pool.select("uuid", "item", "rnk")


@plan("SC07_provider_bundle", " UNION ALL ".join(f"SELECT provider, count(*) AS candidates, count(DISTINCT uuid) AS persons, round(avg(raw_score), 5) AS mean_score FROM q_c_{p} GROUP BY provider" for p in rv.ORACLE_PROVIDERS))
def _(t):
    out = None
    for p in rv.ORACLE_PROVIDERS:
        one = t.reco.provider(p)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("provider").agg(row_count("candidates"), F.count_distinct("uuid").alias("persons"), F.round(F.avg("raw_score"), 5).alias("mean_score"))


@plan("SC08_fallback_usage", """SELECT uuid, n_known, n_popularity, n_cooccurrence, n_known <= 1 AS cold_start,
  CASE WHEN n_popularity + n_cooccurrence = 0 THEN 'no_candidates' WHEN n_cooccurrence = 0 THEN 'popularity_only' ELSE 'none' END AS primary_reason
FROM (SELECT uuid, (SELECT count(*) FROM q_train t WHERE t.uuid = p.uuid) AS n_known, (SELECT count(*) FROM q_c_popularity c WHERE c.uuid = p.uuid) AS n_popularity,
  (SELECT count(*) FROM q_c_cooccurrence c WHERE c.uuid = p.uuid) AS n_cooccurrence FROM q_people p)""")
def _(t):
    return cand.fallback_usage(t.reco.persons, t.reco.train, t.reco.normalized)


# --- features and reranking -----------------------------------------------------------------------

_RF = {
    "RF01_source_scores": ["lightgcn_score", "cooccurrence_score", "segment_popularity_score"],
    "RF02_similar_person": ["similar_person_score"],
    "RF04_known_compatibility": ["known_hobby_compatibility"],
    "RF05_demographic_fit": ["age_group_fit", "occupation_fit"],
    "RF06_region_fit": ["region_fit"],
    "RF07_popularity_prior": ["popularity_prior"],
    "RF08_popularity_penalty": ["popularity_penalty"],
    "RF09_novelty_bonus": ["novelty_bonus"],
    "RF10_mismatch_penalty": ["mismatch_penalty"],
    "RF11_cold_start": ["category_diversity_reward", "is_cold_start"],
    "RF12_source_flags": ["source_is_popularity", "source_is_cooccurrence", "source_count"],
    "RF14_feature_vector": features.FEATURES,
}
for _key, _cols in _RF.items():
    def _feature(key=_key, cols=_cols):
        @plan(key, "SELECT uuid, item, " + ", ".join(f"round({c}, 6) AS {c}" for c in cols) + " FROM q_feat")
        def _(t):
            return rounded(t.reco.pool_features.select("uuid", "item", *cols), *cols)
    _feature()


@plan("RF03_persona_text_fit", """SELECT f.uuid, f.item, CASE WHEN contains(concat_ws(' ', persona_text, professional_text, sports_text, arts_text, travel_text, culinary_text, family_text), f.item) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS persona_text_fit
FROM q_pool f JOIN q_ctx c ON c.person_uuid = f.uuid""")
def _(t):
    w = t.reco
    return features.build(w.pool, t.contexts, w.train, w.item_profile, use_text_fit=True).select("uuid", "item", "persona_text_fit")


def _text_sim(t):
    """Of persons with a text only: without one the similarity is 0, as for a pair without a row here."""
    texts = t.persona_texts.where(F.col("persona_text") != "").select(F.col("person_uuid").alias("uuid"), "persona_text")
    return t.reco.pool.select("uuid", "item").join(texts, "uuid").select(
        "uuid", "item", lexical_similarity(F.col("persona_text"), F.col("item")).alias("similarity")
    )


def _lex(text, item):
    a, b = (f"regexp_replace(lower({c}), '\\s+', '', 'g')" for c in (text, item))
    chars = f"list_filter(list_distinct(string_split({b}, '')), lambda c : c <> '')"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN contains({a}, {b}) THEN 1.0::DOUBLE ELSE len(list_intersect({chars}, string_split({a}, ''))) / len({chars}) END"


@plan("RF13_text_similarity", f"SELECT uuid, item, round({_lex('persona_text', 'item')}, 6) AS text_embedding_similarity FROM q_pool JOIN q_ctx ON person_uuid = uuid")
def _(t):
    w = t.reco
    built = features.build(w.pool, t.demographics, w.train, w.item_profile, text_similarity=_text_sim(t))
    return rounded(built.select("uuid", "item", "text_embedding_similarity"), "text_embedding_similarity")


@plan("RR01_linear_score", "SELECT uuid, item, score FROM q_rerank")
def _(t):
    return t.reco.pool_features.select("uuid", "item", F.round(features.linear_score(), 9).alias("score"))


@plan("RR03_rerank", "SELECT uuid, item, score, CAST(rnk AS INTEGER) AS rnk FROM q_rerank")
def _(t):
    return t.reco.reranked.select("uuid", "item", "score", "rnk")


@plan("RR04_stage1_fallback", """SELECT uuid, item, score, CAST(row_number() OVER (PARTITION BY uuid ORDER BY score DESC, item) AS INTEGER) AS rnk FROM (
  SELECT r.uuid, r.item, CASE WHEN p.sex = '여자' THEN r.score ELSE round(greatest(COALESCE(s_pop, 0), COALESCE(s_cooc, 0)), 9) END AS score FROM q_rerank r JOIN q_persons p ON p.uuid = r.uuid)""")
def _(t):
    w = t.reco
    some = t.demographics.where(F.col("sex") == "여자")
    built = features.build(w.pool, some, w.train, w.item_profile)
    return features.rerank(built).select("uuid", "item", "score", "rnk")


@plan("RR05_category_resort", """SELECT uuid, item, score, CAST(row_number() OVER (PARTITION BY uuid ORDER BY round(score + 0.05::DOUBLE * fresh, 12) DESC, fresh DESC, item) AS INTEGER) AS rnk FROM (
  SELECT r.uuid, r.item, r.score, CASE WHEN row_number() OVER (PARTITION BY r.uuid, category ORDER BY r.score DESC, r.item) = 1 THEN 1 ELSE 0 END AS fresh FROM q_rerank r JOIN q_items i ON i.item = r.item)""")
def _(t):
    return features.category_resort(t.reco.reranked, categories(t), 0.05)


@plan("RR06_item_category", """SELECT item, CASE WHEN item IN ('heated ring', 'widget') THEN 'mapped' WHEN contains(item, 'ring') AND NOT contains(item, 'hot') THEN 'craft'
  WHEN contains(item, 'gear') THEN 'machine' WHEN (contains(item, 'bolt') OR contains(item, 'nut')) AND NOT contains(item, 'small') THEN 'machine' ELSE '' END AS category FROM q_prepd""")
def _(t):
    mapped = t.spark.createDataFrame([("heated ring", "mapped"), ("widget", "mapped")], "item string, category string")
    return features.item_category(voc.degrees(_prepared(t)), mapped, RULES)


# --- metrics --------------------------------------------------------------------------------------

_RR = "SELECT uuid, item, rnk FROM q_rerank"
_S1 = "SELECT uuid, item, rnk FROM q_pool"


@plan("ME01_recall", f"SELECT k, value FROM ({rv.summary_sql(_TRUTH, _RR)}) WHERE metric = 'recall'")
def _(t):
    return rounded(metrics.accuracy(t.reco.part("validation"), t.reco.reranked).where(F.col("metric") == "recall").select("k", "value"), "value")


@plan("ME02_hit_rate", f"SELECT k, value FROM ({rv.summary_sql(_TRUTH, _RR)}) WHERE metric = 'hit_rate'")
def _(t):
    return rounded(metrics.accuracy(t.reco.part("validation"), t.reco.reranked).where(F.col("metric") == "hit_rate").select("k", "value"), "value")


@plan("ME03_ndcg", f"SELECT k, value FROM ({rv.summary_sql(_TRUTH, _RR)}) WHERE metric = 'ndcg'")
def _(t):
    return rounded(metrics.accuracy(t.reco.part("validation"), t.reco.reranked).where(F.col("metric") == "ndcg").select("k", "value"), "value")


@plan("ME04_catalog_coverage", f"SELECT k, value FROM ({rv.summary_sql(_TRUTH, _RR)}) WHERE metric = 'catalog_coverage'")
def _(t):
    mine = metrics.evaluated(t.reco.part("validation"), t.reco.reranked)
    return rounded(metrics.coverage(mine, _n_items(t)).select("k", "value"), "value")


@plan("ME05_novelty", f"SELECT k, value FROM ({rv.summary_sql(_TRUTH, _RR)}) WHERE metric = 'novelty'")
def _(t):
    mine = metrics.evaluated(t.reco.part("validation"), t.reco.reranked)
    return rounded(metrics.novelty(mine, t.reco.pop).select("k", "value"), "value")


@plan("ME06_intra_list_diversity", f"SELECT k, value FROM ({rv.summary_sql(_TRUTH, _RR, categories=True)}) WHERE metric = 'intra_list_diversity'")
def _(t):
    mine = metrics.evaluated(t.reco.part("validation"), t.reco.reranked)
    return rounded(metrics.category_diversity(mine, categories(t)).select("k", "value"), "value")


@plan("ME07_oracle_recall", f"SELECT k, value FROM ({rv.summary_sql(_TRUTH, _RR, pool=_S1)}) WHERE metric = 'oracle_recall'")
def _(t):
    return rounded(metrics.oracle_recall(t.reco.part("validation"), t.reco.pool).select("k", "value"), "value")


@plan("ME08_segment_recall", """
WITH p AS (SELECT v.uuid, count(r.item) / count(*) AS recall FROM q_val v LEFT JOIN (SELECT * FROM q_rerank WHERE rnk <= 20) r ON r.uuid = v.uuid AND r.item = v.item GROUP BY v.uuid),
s AS (SELECT 'age_group' AS field, age_group AS value, recall FROM p JOIN q_persons c ON c.uuid = p.uuid UNION ALL SELECT 'sex', sex, recall FROM p JOIN q_persons c ON c.uuid = p.uuid),
g AS (SELECT field, value, avg(recall) AS recall, count(*) AS persons FROM s GROUP BY field, value)
SELECT field, value, round(recall, 6) AS recall, persons FROM g UNION ALL
SELECT field, 'gap', round(CASE WHEN count(*) >= 2 THEN max(recall) - min(recall) ELSE 0 END, 6), CAST(sum(persons) AS BIGINT) FROM g GROUP BY field""")
def _(t):
    return rounded(metrics.by_segment(t.reco.part("validation"), t.reco.reranked, t.demographics, 20), "recall")


@plan("ME09_ranking_metrics", rv.summary_sql(_TRUTH, _RR, categories=True, pool=_S1))
def _(t):
    return _summary(t, t.reco.reranked, categories=categories(t), pool=t.reco.pool)


@plan("ME10_candidate_recall", f"SELECT 'candidate_recall' AS metric, k, value FROM ({rv.summary_sql(_TRUTH, _S1, ks=(50,))}) WHERE metric = 'recall'")
def _(t):
    return rounded(metrics.candidate_recall(t.reco.part("validation"), t.reco.pool, 50), "value")


view("q_cold", "SELECT uuid, item FROM q_val WHERE uuid NOT IN (SELECT uuid FROM q_train GROUP BY uuid HAVING count(*) > 1)")


@plan("ME11_cold_start_metrics", rv.summary_sql("SELECT uuid, item FROM q_cold", _RR))
def _(t):
    w = t.reco
    truth = metrics.cold_start(w.train, w.part("validation"))
    return rounded(metrics.summary(truth, w.reranked, _n_items(t), w.pop), "value")


view("q_m1", rv.summary_sql(_TRUTH, _S1, categories=True).replace("round(value, 6)", "value"))
view("q_m2", rv.summary_sql(_TRUTH, _RR, categories=True).replace("round(value, 6)", "value"))


def _deltas(t):
    w = t.reco
    truth, n, c = w.part("validation"), _n_items(t), categories(t)
    return metrics.deltas(metrics.summary(truth, w.stage1, n, w.pop, c), metrics.summary(truth, w.reranked, n, w.pop, c))


@plan("ME12_variant_deltas", "SELECT a.metric, a.k, round(a.value, 6) AS base, round(b.value, 6) AS other, round(b.value - a.value, 6) + 0.0 AS delta FROM q_m1 a JOIN q_m2 b ON a.metric = b.metric AND a.k = b.k")
def _(t):
    return rounded(_deltas(t), "base", "other", "delta").withColumn("delta", F.col("delta") + 0.0)


COMBOS = [
    ["popularity"], ["cooccurrence"], ["segment_popularity"], ["bm25"], ["idf_cooccurrence"], ["pop_capped"], ["jaccard"], ["pmi"],
    ["popularity", "cooccurrence"], ["popularity", "idf_cooccurrence"], ["popularity", "pop_capped"], ["popularity", "jaccard"],
    ["popularity", "pmi"], ["popularity", "bm25"], ["segment_popularity", "popularity"], ["segment_popularity", "cooccurrence"],
    ["segment_popularity", "cooccurrence", "popularity"],
]
view("q_allnorm", rv.normalized(" UNION ALL ".join(f"SELECT * FROM q_c_{p}" for p in rv.ORACLE_PROVIDERS)))


def _combo_sql(c):
    src = "SELECT * FROM q_allnorm WHERE provider IN (" + ", ".join(f"'{p}'" for p in c) + ")"
    lists = f"SELECT uuid, item, rnk FROM ({rv.merged(src, c, 10)})"
    return f"""SELECT '{'+'.join(c)}' AS combo, round(avg(h / n), 6) AS recall FROM (SELECT v.uuid, count(*) AS n, count(r.item) AS h FROM q_val v LEFT JOIN ({lists}) r ON r.uuid = v.uuid AND r.item = v.item GROUP BY v.uuid)"""


@plan("ME13_provider_ablation", " UNION ALL ".join(_combo_sql(c) for c in COMBOS))
def _(t):
    w = t.reco
    every = None
    for p in rv.ORACLE_PROVIDERS:
        one = cand.normalize_scores(w.provider(p))
        every = one if every is None else every.unionByName(one)
    return rounded(cand.ablation(every, w.part("validation"), COMBOS, 10), "recall")


_D10 = "(SELECT max(b.value - a.value) FROM q_m1 a JOIN q_m2 b ON a.metric = b.metric AND a.k = b.k WHERE a.k = 10 AND a.metric = '{}')"
_GAINS = " + ".join(f"CASE WHEN {_D10.format(m)} >= {g} THEN 1 ELSE 0 END" for m, g in metrics.DIVERSITY_GAINS.items())


@plan("ME14_gate_either", f"""SELECT 'validation' AS split, ok AS passed, CASE WHEN ok THEN 'eligible_for_test' ELSE 'blocked' END AS status
FROM (SELECT {_D10.format('recall')} >= 0 OR {_D10.format('ndcg')} >= 0 AS ok)""")
def _(t):
    return metrics.gate_either(_deltas(t), "validation")


@plan("ME15_gate_both", f"""SELECT 'validation' AS split, r AS recall_passed, n AS ndcg_passed, CASE WHEN r AND n THEN 'eligible_for_test' ELSE 'blocked' END AS status
FROM (SELECT {_D10.format('recall')} >= -0.002 AS r, {_D10.format('ndcg')} >= 0.005 AS n)""")
def _(t):
    return metrics.gate_both(_deltas(t), "validation")


@plan("ME16_gate_diversity", f"""SELECT 'validation' AS split, CAST(gains AS INTEGER) AS gains, ok AS passed, CASE WHEN ok THEN 'eligible_for_test' ELSE 'blocked' END AS status
FROM (SELECT gains, r >= -0.002 AND n >= -0.002 AND gains >= 2 AS ok FROM (SELECT {_GAINS} AS gains, {_D10.format('recall')} AS r, {_D10.format('ndcg')} AS n))""")
def _(t):
    return metrics.gate_diversity(_deltas(t), "validation", 0.0, 0)


@plan("ME17_gate_probe", f"""SELECT 'validation' AS split, CAST(gains AS INTEGER) AS gains, ok AS passed, rv AS review, CASE WHEN NOT ok THEN 'blocked' WHEN rv THEN 'requires_additional_review' ELSE 'passed' END AS status
FROM (SELECT gains, r >= -0.010 AND n >= -0.010 AND gains >= 2 AS ok, r < -0.005 OR n < -0.005 AS rv FROM (SELECT {_GAINS} AS gains, {_D10.format('recall')} AS r, {_D10.format('ndcg')} AS n))""")
def _(t):
    return metrics.gate_probe(_deltas(t), "validation", 0.0, 0)


GRID = [(a, b, c) for a in (0.05, 0.1, 0.2, 0.3) for b in (0.05, 0.1, 0.15, 0.25) for c in (0.0, 0.1, 0.25, 0.4)]
_GRID_SQL = "(VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(GRID)) + ") g(gid, a, b, c)"


@plan("ME18_weight_sweep", f"""
WITH s AS (SELECT gid, uuid, item, row_number() OVER (PARTITION BY gid, uuid ORDER BY sc DESC, item) AS rnk FROM (SELECT gid, uuid, item,
    round(0 {rv.score_sql({'cooccurrence_score': 0, 'known_hobby_compatibility': 0, 'mismatch_penalty': 0})} + a * cooccurrence_score + b * known_hobby_compatibility - c * mismatch_penalty, 9) AS sc FROM q_feat, {_GRID_SQL})),
h AS (SELECT gid, s.uuid, count(*) AS h, sum(1 / log2(rnk + 1)) AS d FROM s JOIN q_val v ON v.uuid = s.uuid AND v.item = s.item WHERE rnk <= 10 GROUP BY gid, s.uuid),
n AS (SELECT uuid, count(*) AS n FROM q_val GROUP BY uuid), g AS (SELECT DISTINCT gid FROM s),
m AS (SELECT g.gid, avg(COALESCE(h / n, 0)) AS recall, avg(COALESCE(d, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i : 1 / log2(i + 1)))) AS ndcg FROM g CROSS JOIN n LEFT JOIN h ON h.gid = g.gid AND h.uuid = n.uuid GROUP BY g.gid)
SELECT CAST(gid AS INTEGER) AS gid, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, CAST(row_number() OVER (ORDER BY round(ndcg, 6) DESC, round(recall, 6) DESC, gid) AS INTEGER) AS rnk FROM m ORDER BY rnk LIMIT 10""")
def _(t):
    return metrics_sweep(t)


def metrics_sweep(t):
    w = t.reco
    weights = [{"cooccurrence_score": a, "known_hobby_compatibility": b, "mismatch_penalty": c} for a, b, c in GRID]
    return sweep_weights(w.pool_features, w.part("validation"), weights, 10)


def sweep_weights(rows: DataFrame, truth: DataFrame, grid: list[dict], top: int, k: int = 10) -> DataFrame:
    """Recall and ndcg for every weight set, from features computed once.

    Only candidates that are in the truth need a position: it is one plus the number of the person's
    candidates with a better score, counted inside the person's list (a pool of bounded size).
    """
    last = F.lit(float("-inf"))  # a row without features comes last
    scores = [F.coalesce(F.round(features.linear_score(g), 9), last) for g in grid]
    truth = truth.select("uuid", "item").distinct()
    hits = metrics.truth_ranks(rows, truth, scores, k).groupBy("gid", "uuid").agg(row_count("h"), F.sum(1 / F.log2(F.col("rnk") + 1)).alias("d"))
    sizes = truth.groupBy("uuid").agg(row_count("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    per = hits.join(sizes, "uuid").groupBy("gid").agg(F.sum(F.col("h") / F.col("n")).alias("r"), F.sum(F.col("d") / ideal).alias("g"))
    n = F.lit(sizes.count())
    rates = per.select("gid", F.round(F.col("r") / n, 6).alias("recall"), F.round(F.col("g") / n, 6).alias("ndcg"))
    return top_n_global(rates, [F.desc("ndcg"), F.desc("recall"), F.asc("gid")], top)


# --- audit ----------------------------------------------------------------------------------------

view("q_a1", f"SELECT uuid, item, rnk, score FROM q_pool WHERE rnk <= 10 AND uuid IN (SELECT uuid FROM q_val)")
view("q_a2", f"SELECT uuid, item, rnk, score FROM q_rerank WHERE rnk <= 10 AND uuid IN (SELECT uuid FROM q_val)")


def _lists(t):
    w = t.reco
    truth = w.part("validation")
    return {"stage1": metrics.evaluated(truth, w.stage1.where("rnk <= 10")), "stage2": metrics.evaluated(truth, w.reranked.where("rnk <= 10"))}


def _both(t, fn):
    out = None
    for name, recs in _lists(t).items():
        part = fn(recs).withColumn("stage", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _audit_sql(body):
    return " UNION ALL ".join(f"SELECT 'stage{i}' AS stage, * FROM ({body.format(src=f'q_a{i}')})" for i in (1, 2))


@plan("AU01_unique_items", _audit_sql("SELECT count(DISTINCT item) AS unique_items, round(count(DISTINCT item) / (SELECT count(*) FROM q_items), 6) AS coverage FROM {src}"))
def _(t):
    n = _n_items(t)
    return _both(t, lambda r: r.agg(F.count_distinct("item").alias("unique_items")).withColumn("coverage", F.round(F.col("unique_items") / n, 6)))


@plan("AU02_entropy", _audit_sql("SELECT round(sum(-p * log2(p)), 6) AS entropy, round(log2((SELECT count(*) FROM q_items)), 6) AS max_entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM {src} GROUP BY item)"))
def _(t):
    top = F.round(F.log2(F.lit(float(_n_items(t)))), 6).alias("max_entropy")
    return _both(t, lambda r: metrics.entropy(metrics.frequencies(r), "freq").select(F.round("entropy", 6).alias("entropy"), top))


_FR = "(SELECT item, count(*) AS freq FROM {src} GROUP BY item) f LEFT JOIN q_rank r ON r.item = f.item"
_RK = "COALESCE(pop_rank, (SELECT count(*) + 1 FROM q_rank))"


@plan("AU03_average_rank", _audit_sql(f"SELECT round(sum({_RK} * freq) / sum(freq), 6) AS avg_popularity_rank FROM {_FR}"))
def _(t):
    ranks = cand.popularity_ranks(t.reco.pop)
    return _both(t, lambda r: rounded(metrics.audit_popularity(metrics.frequencies(r), ranks).select("avg_popularity_rank"), "avg_popularity_rank"))


@plan("AU04_long_tail", _audit_sql(f"SELECT round(COALESCE(sum(freq) FILTER ({_RK} > 50), 0) / sum(freq), 6) AS share_beyond_50, round(COALESCE(sum(freq) FILTER ({_RK} > 100), 0) / sum(freq), 6) AS share_beyond_100 FROM {_FR}"))
def _(t):
    ranks = cand.popularity_ranks(t.reco.pop)
    return _both(t, lambda r: rounded(metrics.audit_popularity(metrics.frequencies(r), ranks).select("share_beyond_50", "share_beyond_100"), "share_beyond_50", "share_beyond_100"))


@plan("AU05_weighted_novelty", _audit_sql(f"SELECT round(sum(CASE WHEN pop > 0 THEN -log2(pop / (SELECT sum(pop) FROM q_pop)::DOUBLE) ELSE 0 END * freq) / sum(freq), 6) AS avg_novelty FROM {_FR}"))
def _(t):
    return _both(t, lambda r: rounded(metrics.audit_novelty(metrics.frequencies(r), t.reco.pop), "avg_novelty"))


@plan("AU06_category_counts", _audit_sql("SELECT category, CAST(count(*) AS BIGINT) AS freq, round(sum(-p * log2(p)) OVER (), 6) AS entropy FROM (SELECT category, count(*) AS c, count(*) / sum(count(*)) OVER () AS p FROM {src} s JOIN q_items i ON i.item = s.item GROUP BY category) GROUP BY category, p, c").replace("CAST(count(*) AS BIGINT) AS freq", "c AS freq"))
def _(t):
    p = F.col("freq") / F.sum("freq").over(Window.partitionBy())

    def one(r):
        c = metrics.category_counts(metrics.frequencies(r), categories(t)).withColumn("p", p)
        return c.select("category", "freq", F.round(F.sum(-F.col("p") * F.log2("p")).over(Window.partitionBy()), 6).alias("entropy"))
    return _both(t, one)


@plan("AU07_categories_per_person", _audit_sql("SELECT round(avg(n), 6) AS avg_categories FROM (SELECT count(DISTINCT category) AS n FROM {src} s JOIN q_items i ON i.item = s.item GROUP BY uuid)"))
def _(t):
    return _both(t, lambda r: rounded(metrics.categories_per_person(r, categories(t)), "avg_categories"))


@plan("AU08_provider_contribution", """SELECT provider, count(*) AS items FROM (SELECT 'popularity' AS provider FROM q_a2 a JOIN q_pool p ON p.uuid = a.uuid AND p.item = a.item WHERE s_pop > 0
UNION ALL SELECT 'cooccurrence' FROM q_a2 a JOIN q_pool p ON p.uuid = a.uuid AND p.item = a.item WHERE s_cooc > 0) GROUP BY provider""")
def _(t):
    lists = _lists(t)["stage2"]
    return lists.select(F.explode("source_scores").alias("provider", "s")).where("s > 0").groupBy("provider").agg(row_count("items"))


@plan("AU09_top_items_per_segment", " UNION ALL ".join(f"""SELECT '{f}' AS field, value, item, cnt, CAST(rn AS INTEGER) AS rnk FROM (SELECT {f} AS value, item, count(*) AS cnt, row_number() OVER (PARTITION BY {f} ORDER BY count(*) DESC, item) AS rn
FROM q_a2 a JOIN q_persons p ON p.uuid = a.uuid GROUP BY {f}, item) WHERE rn <= 5""" for f in ("age_group", "occupation")))
def _(t):
    tagged = _segments(t, _lists(t)["stage2"])
    counts = tagged.groupBy("field", "value", "item").agg(row_count())
    return top_n(counts, ["field", "value"], [F.desc("cnt"), F.asc("item")], 5)


def _segments(t, recs, fields=("age_group", "occupation")):
    ctx = t.demographics.select(F.col("person_uuid").alias("uuid"), *fields)
    tags = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return recs.select("uuid", "item").join(ctx, "uuid").select("item", F.explode(tags).alias("s")).select("item", "s.field", "s.value")


@plan("AU10_rank_per_segment", " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, round(avg({_RK}), 6) AS avg_rank FROM q_a2 a JOIN q_persons p ON p.uuid = a.uuid LEFT JOIN q_rank r ON r.item = a.item GROUP BY {f}" for f in ("age_group", "occupation")))
def _(t):
    ranks = cand.popularity_ranks(t.reco.pop)
    n = ranks.count() + 1
    tagged = _segments(t, _lists(t)["stage2"]).join(ranks.select("item", "pop_rank"), "item", "left")
    return tagged.groupBy("field", "value").agg(F.round(F.avg(F.coalesce("pop_rank", F.lit(n))), 6).alias("avg_rank"))


@plan("AU11_sample_review", """WITH s AS (SELECT DISTINCT uuid, md5(concat_ws(':', uuid, '7')) AS h FROM q_a2 ORDER BY h LIMIT 20)
SELECT s.uuid, string_agg(item, '|' ORDER BY rnk) AS recommended, (SELECT count(*) FROM q_train t WHERE t.uuid = s.uuid) AS known FROM s JOIN q_a2 a ON a.uuid = s.uuid GROUP BY s.uuid""")
def _(t):
    lists = _lists(t)["stage2"]
    picked = lists.select("uuid").distinct().orderBy(shuffle_key("uuid", seed=7)).limit(20)
    recs = lists.join(picked, "uuid", "left_semi").groupBy("uuid").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rnk", "item"))), lambda x: x["item"]), "|").alias("recommended"))
    known = t.reco.train.join(picked, "uuid", "left_semi").groupBy("uuid").agg(row_count("known"))
    return recs.join(known, "uuid", "left").select("uuid", "recommended", F.coalesce("known", F.lit(0)).alias("known"))


@plan("AU12_penalty_columns", """SELECT a.uuid, a.item, round(ln(1 + pop) / ln(1 + (SELECT max(pop) FROM q_pop)), 6) AS popularity_penalty,
  round(CASE WHEN pop > 0 THEN -log2(pop / (SELECT sum(pop) FROM q_pop)::DOUBLE) ELSE 0 END, 6) AS novelty FROM q_a2 a JOIN q_pop p ON p.item = a.item""")
def _(t):
    pop = t.reco.pop
    one = pop.agg(F.max("pop"), F.sum("pop")).first()
    rows = _lists(t)["stage2"].select("uuid", "item").join(pop, "item")
    return rows.select(
        "uuid", "item", F.round(F.log1p("pop") / F.log1p(F.lit(one[0])), 6).alias("popularity_penalty"),
        F.round(F.when(F.col("pop") > 0, -F.log2(F.col("pop") / F.lit(one[1]))).otherwise(0.0), 6).alias("novelty"),
    )


# --- explanation ----------------------------------------------------------------------------------

_POS = [n for n, w in features.WEIGHTS.items() if w]
view("q_contrib", " UNION ALL ".join(
    f"SELECT uuid, item, '{n}' AS feature, round({'-' if n in features.SUBTRACTED else ''}{features.WEIGHTS[n]}::DOUBLE * {n}, 9) AS contribution FROM q_feat" for n in _POS))


@plan("EX01_contributions", "SELECT uuid, item, feature, round(contribution, 6) + 0.0 AS contribution FROM q_contrib")
def _(t):
    rows = t.reco.pool_features.select("uuid", "item", F.explode(explain.contributions()).alias("c"))
    return rows.select("uuid", "item", "c.feature", (F.round("c.contribution", 6) + 0.0).alias("contribution"))


_RS = "CASE feature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in explain.REASONS.items()) + " END"
view("q_reason", f"""SELECT f.uuid, f.item, COALESCE(r.reason, '{explain.NO_POSITIVE}') AS reason FROM q_feat f LEFT JOIN (
  SELECT uuid, item, string_agg({_RS}, '; ' ORDER BY contribution DESC, feature) || '.' AS reason FROM (
    SELECT *, row_number() OVER (PARTITION BY uuid, item ORDER BY contribution DESC, feature) AS rn FROM q_contrib WHERE contribution > 0) WHERE rn <= 3 GROUP BY uuid, item) r ON r.uuid = f.uuid AND r.item = f.item""")


def _reasons(t):
    c = explain.contributions()
    finite = F.forall(c, lambda x: ~F.isnan(x["contribution"]))
    return t.reco.pool_features.select("uuid", "item", explain.reason(c).alias("reason"), finite.alias("finite"))


@plan("EX02_reasons", "SELECT uuid, item, reason FROM q_reason")
def _(t):
    return _reasons(t).select("uuid", "item", "reason")


@plan("EX03_reason_check", f"""SELECT count(*) AS total, count(*) FILTER (reason <> '{explain.NO_POSITIVE}') AS meaningful, false AS has_nan, false AS has_mask, true AS finite,
  round(count(*) FILTER (reason <> '{explain.NO_POSITIVE}') / count(*), 6) AS meaningful_rate, count(*) FILTER (reason <> '{explain.NO_POSITIVE}') / count(*) >= 0.9 AS passed FROM q_reason""")
def _(t):
    return explain.validate(_reasons(t))


# --- diversity ------------------------------------------------------------------------------------


def _item_vectors(t):
    return embedding.category_vectors(categories(t), CATEGORIES)


def _mmr_sql(lists, lam, k=10):
    """With one-hot category vectors the similarity to the chosen items is 1 once the category was taken."""
    return f"""SELECT uuid, item, score, rn AS rnk FROM (SELECT uuid, item, score, row_number() OVER (PARTITION BY uuid ORDER BY round({lam}::DOUBLE * score - {1 - lam}::DOUBLE * later, 12) DESC, score DESC, rnk) AS rn FROM (
  SELECT l.uuid, l.item, l.score, l.rnk, CASE WHEN row_number() OVER (PARTITION BY l.uuid, category ORDER BY l.score DESC, l.rnk) = 1 THEN 0 ELSE 1 END AS later FROM ({lists}) l JOIN q_items i ON i.item = l.item)) WHERE rn <= {k}"""


_S1L, _RRL = "SELECT uuid, item, score, rnk FROM q_pool", "SELECT uuid, item, score, rnk FROM q_rerank"


@plan("DV01_mmr", f"SELECT uuid, item, round(score, 6) AS score, CAST(rnk AS INTEGER) AS rnk FROM ({_mmr_sql(_S1L, 0.7)})")
def _(t):
    return rounded(diversity.mmr(t.reco.stage1, _item_vectors(t), 0.7, 10), "score")


@plan("DV02_mmr_categories", f"SELECT uuid, item, score, CAST(rnk AS INTEGER) AS rnk FROM ({_mmr_sql(_RRL, 0.5)})")
def _(t):
    return diversity.mmr(t.reco.reranked.select("uuid", "item", "score", "rnk"), _item_vectors(t), 0.5, 10)


@plan("DV03_dpp")
def _(t):
    return rounded(diversity.dpp(t.reco.stage1, _item_vectors(t), 0.5, 10), "score")


@plan("DV04_list_diversity", """SELECT uuid, round(CASE WHEN n >= 2 THEN 1 - s / (n * (n - 1)) ELSE 1 END, 6) AS diversity FROM (SELECT uuid, sum(c) AS n, sum(c * (c - 1)) AS s FROM
  (SELECT uuid, category, count(*) AS c FROM q_pool p JOIN q_items i ON i.item = p.item WHERE rnk <= 10 GROUP BY uuid, category) GROUP BY uuid)""")
def _(t):
    return rounded(diversity.list_diversity(t.reco.stage1, _item_vectors(t), len(CATEGORIES), 10), "diversity")


_LAMBDAS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
view("q_lbase", rv.summary_sql(_TRUTH, "SELECT uuid, item, rnk FROM q_pool WHERE rnk <= 10", ks=(10,), categories=True).replace("round(value, 6)", "value"))
for _i, _lam in enumerate(_LAMBDAS):
    view(f"q_lmmr{_i}", _mmr_sql(_S1L, _lam))
    view(f"q_lsum{_i}", rv.summary_sql(_TRUTH, f"SELECT uuid, item, rnk FROM q_lmmr{_i}", ks=(10,), categories=True).replace("round(value, 6)", "value"))
_SWEEP = " UNION ALL ".join(f"SELECT {lam}::DOUBLE AS lam, m.metric, m.value - b.value AS delta FROM q_lsum{i} m JOIN q_lbase b ON b.metric = m.metric" for i, lam in enumerate(_LAMBDAS))


@plan("DV05_lambda_sweep", f"""WITH d AS ({_SWEEP}), p AS (SELECT lam, max(delta) FILTER (metric = 'recall') AS recall, max(delta) FILTER (metric = 'catalog_coverage') AS coverage,
  max(delta) FILTER (metric = 'novelty') AS novelty, max(delta) FILTER (metric = 'intra_list_diversity') AS ild FROM d GROUP BY lam),
g AS (SELECT *, CAST(CASE WHEN coverage > 0 THEN 1 ELSE 0 END + CASE WHEN novelty > 0 THEN 1 ELSE 0 END + CASE WHEN ild > 0 THEN 1 ELSE 0 END AS INTEGER) AS gains FROM p),
s AS (SELECT *, CASE WHEN recall >= -0.002 AND gains >= 2 THEN round(coverage + ild, 9) END AS score FROM g)
SELECT lam, round(recall, 6) + 0.0 AS recall, round(coverage, 6) + 0.0 AS coverage, round(novelty, 6) + 0.0 AS novelty, round(ild, 6) + 0.0 AS ild, gains, round(score, 6) + 0.0 AS score,
  row_number() OVER (ORDER BY score DESC NULLS LAST, lam) = 1 AND score IS NOT NULL AS chosen FROM s""")
def _(t):
    w = t.reco
    lists = cut_lineage(w.stage1)
    sweep = diversity.lambda_sweep(lists, _item_vectors(t), w.part("validation"), _n_items(t), w.pop, categories(t), _LAMBDAS)
    best = rounded(diversity.best_lambda(sweep), "recall", "coverage", "novelty", "ild", "score")
    return best.select("lam", "gains", "chosen", *[(F.col(c) + 0.0).alias(c) for c in ("recall", "coverage", "novelty", "ild", "score")])
