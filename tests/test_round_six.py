"""Shared steps are computed once and on narrow rows."""

from types import SimpleNamespace

from test_louvain import planted

from popgraph.operators import features
from popgraph.operators import louvain as lv
from popgraph.plans import reco_plans
from popgraph.sources.tables import Tables


def plan(df):
    return df._jdf.queryExecution().toString()


def test_stored_similarity_is_computed_once(spark, tmp_path):
    rows = [(i, [float(i + 1), float((i * 7) % 5), 1.0], i % 2) for i in range(9)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    similar = Tables(spark, str(tmp_path)).similar
    assert "CartesianProduct" not in plan(similar)
    assert similar.groupBy("src").count().where("count = 5").count() == 9


def test_text_similarity_of_persons_with_a_text(spark):
    pool = spark.createDataFrame([("a", "tea"), ("a", "x"), ("b", "tea")], "uuid string, item string")
    texts = spark.createDataFrame([("a", "green tea"), ("b", "")], "person_uuid string, persona_text string")
    t = SimpleNamespace(reco=SimpleNamespace(pool=pool), persona_texts=texts, contexts=texts)
    assert {tuple(r) for r in reco_plans._text_sim(t).collect()} == {("a", "tea", 1.0), ("a", "x", 0.0)}


def test_text_similarity_meets_pairs_before_the_item_profile(spark):
    pairs = spark.createDataFrame([("a", "tea", {"popularity": 1.0}), ("b", "tea", {"popularity": 0.5})], "uuid string, item string, source_scores map<string,double>")
    ctx = spark.createDataFrame([("a", *["v"] * 5), ("b", *["v"] * 5)], "person_uuid string, " + ", ".join(f"{f} string" for f in features.FIT_FIELDS))
    known = spark.createDataFrame([("a", "x")], "uuid string, item string")
    profile = spark.createDataFrame(
        [("tea", 3, 4, {"sex=v": 0.5}, [("x", 2)], 2)],
        "item string, pop bigint, max_pop bigint, shares map<string,double>, cooc_top array<struct<dst:string,c:bigint>>, cooc_total bigint",
    )
    texts = spark.createDataFrame([("a", "tea", 0.25)], "uuid string, item string, similarity double")
    built = features.build(pairs, ctx, known, profile, text_similarity=texts)
    assert {(r["uuid"], r["text_embedding_similarity"]) for r in built.collect()} == {("a", 0.25), ("b", 0.0)}
    outermost = next(line for line in built._jdf.queryExecution().analyzed().toString().splitlines() if "Join" in line)
    assert "Inner" in outermost  # the item profile, which is wide, comes last


def test_louvain_by_salts_and_decimals_as_by_broadcast_and_bigints(spark, monkeypatch):
    adj = spark.createDataFrame(planted(groups=3, size=6)[1], "src string, dst string")

    def run():
        names, levels = lv.louvain(adj, max_rounds=3, max_levels=1, rows_per_salt=4)
        return sorted(map(tuple, names.collect())), levels

    want = run()
    monkeypatch.setattr(lv, "MAX_BROADCAST_NODES", 0)
    monkeypatch.setattr(lv, "LONG_TOTAL", 0)
    assert run() == want and len(want[0]) == 18
