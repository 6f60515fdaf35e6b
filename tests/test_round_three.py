"""Sweeps in one pass: positions of truths, provider sets, lambdas; nearest vectors of another table."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from popgraph.operators import candidates as cand
from popgraph.operators import diversity, knn, leakage, metrics


def test_truth_ranks_equal_sorted_lists(spark):
    rng = np.random.default_rng(3)
    rows = [(f"u{u}", f"i{i:02d}", float(rng.integers(0, 4)), float(rng.integers(0, 4))) for u in range(12) for i in range(15)]
    df = spark.createDataFrame(rows + [("u0", "i03", 2.0, 2.0)], "uuid string, item string, x double, y double")
    truth = spark.createDataFrame([(f"u{u}", f"i{i:02d}") for u in range(11) for i in (1, 3, 8)] + [("u1", "none")], "uuid string, item string")
    scores = [F.col("x"), F.col("x") - F.col("y"), F.when(F.col("y") > 1, F.col("y"))]
    got = sorted(map(tuple, metrics.truth_ranks(df, truth, scores, 6).collect()))
    want = []
    for g, score in enumerate(scores):
        w = Window.partitionBy("uuid").orderBy(F.desc("s"), F.asc("item"))
        lists = df.withColumn("s", score).where("s IS NOT NULL").withColumn("rnk", F.row_number().over(w)).where("rnk <= 6")
        want += [(g, r["uuid"], r["item"], r["rnk"]) for r in lists.join(truth, ["uuid", "item"]).collect()]
    assert got == sorted(want)


def test_truth_ranks_repeats_no_row_per_score(spark):
    df = spark.createDataFrame([("u", "a", 1.0)], "uuid string, item string, x double")
    plan = metrics.truth_ranks(df, df, [F.col("x") + i for i in range(64)], 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 2 and plan.rindex("Generate posexplode") < plan.index("Aggregate")  # ranks only, after the grouping


def test_ablation_equals_merged_lists(spark):
    rng = np.random.default_rng(4)
    rows = [(f"u{u}", f"i{i:02d}", p, float(rng.integers(0, 9))) for u in range(8) for i in range(30) for p in "abc" if rng.random() < 0.6]
    rows += [("lone", "i01", "a", 1.0), ("lone", "i02", "b", 1.0)]
    normal = cand.normalize_scores(spark.createDataFrame(rows, "uuid string, item string, provider string, raw_score double")).cache()
    truth = spark.createDataFrame([(f"u{u}", f"i{i:02d}") for u in range(9) for i in (2, 5, 11)] + [("lone", "i02")], "uuid string, item string")
    combos = [["a"], ["b", "a"], ["c", "a", "b"]]
    got = {r["combo"]: r["recall"] for r in cand.ablation(normal, truth, combos, 5).collect()}
    for c in combos:
        lists = cand.merge(normal.where(F.col("provider").isin(c)), 5, c)
        want = metrics.accuracy(truth, lists, (5,)).where("metric = 'recall'").first()["value"]
        assert abs(got["+".join(c)] - want) < 1e-12


def test_mmr_of_all_lambdas_equals_one_by_one(spark):
    rng = np.random.default_rng(5)
    items = [(f"i{i:02d}", np.eye(4)[rng.integers(0, 4)].tolist()) for i in range(40)]
    vectors = spark.createDataFrame(items, "item string, embedding array<double>")
    rows = [(f"u{u}", f"i{i:02d}", round(1 - n / 20, 3), n + 1) for u in range(9) for n, i in enumerate(rng.permutation(40)[: 3 + 3 * u])]
    lists = spark.createDataFrame(rows, "uuid string, item string, score double, rnk int")
    got = {}
    for r in diversity.mmr_each(lists, vectors, (0.1, 0.5, 0.9), 10).collect():
        got.setdefault(r["at"], set()).add((r["uuid"], r["item"], r["rnk"]))
    for at, lam in enumerate((0.1, 0.5, 0.9)):
        assert got[at] == {(r["uuid"], r["item"], r["rnk"]) for r in diversity.mmr(lists, vectors, lam, 10).collect()}


def test_nearest_of_another_table(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(130, 6)), rng.normal(size=(70, 6))
    frames = [spark.createDataFrame([(f"{i:03d}", x.tolist()) for i, x in enumerate(m)], "uuid string, embedding array<double>") for m in (b, a)]
    got = {(r["src"], r["rnk"]): r["dst"] for r in knn.nearest_of(*frames, 3, block_rows=16).collect()}
    sims = np.round(b / np.linalg.norm(b, axis=1, keepdims=True) @ (a / np.linalg.norm(a, axis=1, keepdims=True)).T, 9)
    assert got == {(f"{i:03d}", n + 1): f"{j:03d}" for i in range(70) for n, j in enumerate(np.argsort(-sims[i], kind="stable")[:3])}


def test_tfidf_overlap_takes_no_side_to_the_driver(spark, monkeypatch):
    texts = spark.createDataFrame([("a" if i % 3 else "b", i, f"w{i % 5} w{i % 7} x{i}") for i in range(60)], "side string, key int, text string")
    want = leakage.tfidf_overlap(texts, 20).first()["max_cosine"]
    monkeypatch.setattr(knn, "MAX_QUERIES", 4)
    monkeypatch.setattr(knn, "search", None)
    assert leakage.tfidf_overlap(texts, 20).first()["max_cosine"] == want > 0


def test_search_holds_bounded_scores(spark, monkeypatch):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(f"{i:03d}", x.tolist()) for i, x in enumerate(rng.normal(size=(90, 4)))], "uuid string, embedding array<double>")
    q = df.limit(8).select(F.col("uuid").alias("query"), "embedding")
    whole = knn.search(df, q, 3).orderBy("query", "rnk").collect()
    monkeypatch.setattr(knn, "SCORES", 16)
    assert knn.search(df, q, 3).orderBy("query", "rnk").collect() == whole


def test_segment_groups_of_a_task_are_bounded(spark, monkeypatch):
    fields = cand.SEGMENT_FIELDS
    contexts = spark.createDataFrame([(f"u{u}", *[f"{f}{u % 3}" for f in fields]) for u in range(40)], ["person_uuid", *fields])
    known = spark.createDataFrame([(f"u{u}", f"i{u % 5}") for u in range(40)], "uuid string, item string")
    pop = known.groupBy("item").agg(F.count(F.lit(1)).alias("pop"))
    histogram = spark.createDataFrame([("occupation", f"occupation{v}", f"i{i}", 0.1 * i) for v in range(3) for i in range(5)], "field string, value string, item string, share double")
    run = lambda: cand.segment_candidates(contexts, known, histogram, pop, 3)
    want = sorted(map(str, run().collect()))
    monkeypatch.setattr(cand, "GROUPS_PER_TASK", 10)  # 40 persons, 5 items: 20 tasks
    plan = run()._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [uuid" in plan and ", 20" in plan
    assert sorted(map(str, run().collect())) == want
