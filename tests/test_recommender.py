import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from popgraph.operators import candidates as cand
from popgraph.operators import diversity, explain, features, interactions, metrics, ranker
from popgraph.operators.workspace import Workspace


def edges(spark, pairs):
    return spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "uuid string, item string")


def test_split_invariants(spark):
    pairs = [(p, i) for p in range(40) for i in range(p % 12 + 1)]
    split = interactions.split_by_person(edges(spark, pairs)).collect()
    assert len(split) == len(pairs) == len({(r["uuid"], r["item"]) for r in split})
    for p in range(40):
        n = p % 12 + 1
        kinds = [r["split"] for r in split if r["uuid"] == str(p)]
        assert kinds.count("train") >= 1
        if n >= 3:
            want = max(1, round(n * 0.1))
            assert kinds.count("validation") == want and kinds.count("test") == min(want, n - 1 - want)
        else:
            assert kinds.count("validation") == (1 if n == 2 else 0)


def test_negatives_avoid_known(spark):
    pairs = [(p, i) for p in range(20) for i in range(10) if (p + i) % 3]
    e = edges(spark, pairs)
    got = interactions.sample_negative(e, e, edges(spark, [(0, i) for i in range(10)])).collect()
    assert len(got) == len(pairs)
    assert all((int(r["uuid"]), int(r["negative"])) not in set(pairs) for r in got)
    full = edges(spark, [(1, 0), (1, 1)])
    with pytest.raises(ValueError):
        interactions.sample_negative(full, full, full)


def test_cooccurrence_in_chunks_equals_counting(spark):
    rng = np.random.default_rng(3)
    held = {p: set(rng.choice(30, size=rng.integers(1, 20), replace=False).tolist()) for p in range(25)}
    held["hot"] = set(range(30))
    e = edges(spark, [(p, i) for p, s in held.items() for i in s])
    want = {}
    for s in held.values():
        for a, b in itertools.permutations(s, 2):
            want[(str(a), str(b))] = want.get((str(a), str(b)), 0) + 1
    got = {(r["src"], r["dst"]): r["c"] for r in interactions.cooccurrence(e, chunk=4).collect()}
    assert got == want


def test_popularity_and_backfill_literals(spark):
    train = edges(spark, [(1, 10), (2, 10), (3, 11), (4, 12)])
    pop, one = interactions.popularity(train), edges(spark, [(1, 10)])
    got = cand.popularity_candidates(one, one, pop, 2).orderBy(F.desc("raw_score"), "item").collect()
    assert [r["item"] for r in got] == ["11", "12"]
    with pytest.raises(ValueError):
        cand.popularity_candidates(one, one, pop, 0)


def test_providers_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    held = {str(p): [str(i) for i in rng.choice(12, size=rng.integers(1, 7), replace=False)] for p in range(30)}
    train = edges(spark, [(p, i) for p, s in held.items() for i in s])
    pop, cooc = interactions.popularity(train), interactions.cooccurrence(train)
    d = {r["item"]: r["pop"] for r in pop.collect()}
    c = {(r["src"], r["dst"]): r["c"] for r in cooc.collect()}
    n, avg = len(held), sum(d.values()) / len(d)
    weight = {
        "cooccurrence": lambda i, j, x: x,
        "bm25": lambda i, j, x: math.log((n - d[i] + .5) / (d[i] + .5) + 1) * x * 2.2 / (x + 1.2 * (.25 + .75 * d[j] / avg)),
        "idf_cooccurrence": lambda i, j, x: x * math.log((n + 1) / (1 + d[j])),
        "pop_capped": lambda i, j, x: x / math.log(1 + d[j]),
        "jaccard": lambda i, j, x: x / (d[i] + d[j] - x),
        "pmi": lambda i, j, x: max(0.0, math.log((x / n) / (d[i] / n * d[j] / n))),
    }
    for kind, w in weight.items():
        got = {}
        for r in cand.item_item(train, cand.item_weights(kind, cooc, pop, train), pop, kind, 100).collect():
            got[(r["uuid"], r["item"])] = r["raw_score"]
        want = {}
        for p, s in held.items():
            for i in s:
                for j in d:
                    if (i, j) in c and j not in s:
                        want[(p, j)] = want.get((p, j), 0.0) + w(i, j, c[(i, j)])
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def scored(spark, rows):
    return spark.createDataFrame(rows, "uuid string, item string, provider string, raw_score double")


def test_normalise_and_merge_literals(spark):
    df = scored(spark, [("p", "10", "a", 3.0), ("p", "11", "a", 1.0)])
    got = {r["item"]: r["score"] for r in cand.normalize_scores(df).collect()}
    assert got == {"10": 1.0, "11": 0.0}
    df = scored(spark, [("p", "10", "a", 2.0), ("p", "11", "a", 6.0), ("q", "1", "a", 2.0), ("q", "2", "a", 2.0)])
    got = {(r["uuid"], r["item"]): r["score"] for r in cand.normalize_scores(df, "min_max").collect()}
    assert got == {("p", "10"): 0.0, ("p", "11"): 1.0, ("q", "1"): 1.0, ("q", "2"): 1.0}
    with pytest.raises(ValueError):
        cand.normalize_scores(df, "softmax")
    two = scored(spark, [("p", "10", "a", 5.0), ("p", "11", "a", 4.0), ("p", "11", "b", 9.0)])
    merged = {r["item"]: r for r in cand.merge(cand.normalize_scores(two), 5, ["a", "b"]).collect()}
    assert merged["11"]["provider"] == "b" and merged["11"]["source_scores"] == {"a": 0.0, "b": 1.0}
    assert merged["10"]["rnk"] == 1 and merged["11"]["rnk"] == 2


def test_metric_literals(spark):
    truth = edges(spark, [(1, 10), (1, 11), (2, 12)])
    recs = spark.createDataFrame([("1", "10", 1), ("1", "20", 2), ("1", "11", 3), ("2", "12", 1), ("2", "30", 2), ("2", "40", 3)], "uuid string, item string, rnk int")
    got = {(r["metric"], r["k"]): r["value"] for r in metrics.accuracy(truth, recs, (1, 3)).collect()}
    assert got[("recall", 1)] == 0.75 and got[("recall", 3)] == 1.0 and got[("hit_rate", 1)] == 1.0
    ideal = 1 + 1 / math.log2(3)
    assert abs(got[("ndcg", 3)] - ((1 + 0.5) / ideal + 1) / 2) < 1e-12
    cats = spark.createDataFrame([("10", "a"), ("20", "a"), ("11", "b")], "item string, category string")
    lists = recs.where("uuid = '1'")
    assert abs(metrics.category_diversity(lists, cats, (3,)).first()["value"] - 2 / 3) < 1e-12
    assert metrics.oracle_recall(truth, edges(spark, [(1, 10), (2, 99)]), (10,)).first()["value"] == 0.25
    empty = metrics.summary(edges(spark, []), recs, 5, spark.createDataFrame([("10", 1)], "item string, pop long"))
    assert {r["value"] for r in empty.collect()} == {0.0}


def deltas(spark, **kw):
    return spark.createDataFrame([(m, 10, float(v)) for m, v in kw.items()], "metric string, k int, delta double")


def test_gates(spark):
    good = deltas(spark, recall=0.0, ndcg=0.006, catalog_coverage=0.03, novelty=0.2, intra_list_diversity=0.0)
    assert metrics.gate_either(good, "validation").first()["status"] == "eligible_for_test"
    assert metrics.gate_both(good, "test").first()["status"] == "promoted"
    assert metrics.gate_diversity(good, "test", 0.0, 0).first()["status"] == "promoted"
    assert metrics.gate_diversity(good, "test", 0.0, 1).first()["status"] == "blocked"
    low = deltas(spark, recall=-0.006, ndcg=0.0, catalog_coverage=0.03, novelty=0.2)
    assert metrics.gate_both(low, "validation").first()["status"] == "blocked"
    assert metrics.gate_probe(low, "validation", 0.0, 0).first()["status"] == "requires_additional_review"
    assert metrics.gate_probe(low, "test", 0.0, 0).first()["status"] == "needs_review"


def slow_mmr(scores, vectors, lam, k):
    chosen, left = [], list(range(len(scores)))
    while left and len(chosen) < k:
        def value(i):
            near = max((vectors[i] @ vectors[j] for j in chosen), default=0.0)
            return (round(lam * scores[i] - (1 - lam) * near, 12), scores[i])
        best = max(left, key=lambda i: (*value(i), -i))
        chosen.append(best)
        left.remove(best)
    return chosen


def slow_dpp(scores, vectors, theta, k):
    rel = (scores - scores.min()) / (scores.max() - scores.min())
    kernel = theta * (np.clip(vectors @ vectors.T, -1, 1) + 1) / 2 + (1 - theta) * np.outer(rel, rel) + 1e-6 * np.eye(len(scores))
    chosen = []
    while len(chosen) < k:
        def value(i):
            idx = [*chosen, i]
            return np.linalg.slogdet(kernel[np.ix_(idx, idx)])[1]
        chosen.append(max((i for i in range(len(scores)) if i not in chosen), key=value))
    return chosen


def test_mmr_and_dpp_equal_definition():
    rng = np.random.default_rng(1)
    for _ in range(5):
        v = rng.normal(size=(15, 4))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        s = rng.random(15)
        for lam in (0.0, 0.3, 0.7, 1.0):
            assert diversity.greedy_mmr(s, v, lam, 10) == slow_mmr(s, v, lam, 10)
        assert diversity.greedy_mmr(s, v, 1.0, 15) == list(np.argsort(-s))
        assert diversity.greedy_dpp(s, v, 0.5, 6) == slow_dpp(s, v, 0.5, 6)


def test_list_diversity(spark):
    lists = spark.createDataFrame([("p", "a", 1.0, 1), ("p", "b", 0.5, 2), ("q", "a", 1.0, 1), ("q", "c", 1.0, 2), ("r", "a", 1.0, 1)], "uuid string, item string, score double, rnk int")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0])], "item string, embedding array<double>")
    got = {r["uuid"]: r["diversity"] for r in diversity.list_diversity(lists, v, 2, 10).collect()}
    assert got == {"p": 1.0, "q": 0.0, "r": 1.0}


def test_category_resort_is_greedy(spark):
    ranked = spark.createDataFrame([("p", "a", 0.9, 1), ("p", "b", 0.85, 2), ("p", "c", 0.8, 3)], "uuid string, item string, score double, rnk int")
    cats = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "item string, category string")
    got = features.category_resort(ranked, cats, 0.1).orderBy("rnk").collect()
    assert [r["item"] for r in got] == ["a", "c", "b"]


def test_unknown_weights_are_rejected():
    with pytest.raises(ValueError):
        features.check_weights({"nope": 1.0})


def test_reasons(spark):
    kind = "array<struct<feature:string,contribution:double>>"
    rows = [([("age_group_fit", 0.3), ("popularity_prior", 0.5), ("mismatch_penalty", -0.9)],), ([("age_group_fit", -0.1)],), ([("age_group_fit", float("nan"))],)]
    got = [r["r"] for r in spark.createDataFrame(rows, f"c {kind}").select(explain.reason(F.col("c")).alias("r")).collect()]
    assert got[0] == "전체적으로 인기 있는 취미입니다; 당신의 연령대에서 인기가 높습니다."
    assert got[1] == explain.NO_POSITIVE and got[2] == explain.NO_VALUES


def test_negative_sampling_literals(spark):
    pos, pool = edges(spark, [(1, 10), (1, 11)]), edges(spark, [(1, i) for i in range(20, 26)])
    items = edges(spark, [(0, i) for i in range(100)]).select("item")
    known = edges(spark, [(1, 30), (1, 20)])
    got = ranker.sample_negatives(pos, pool, known, items, 4, 0.8).collect()
    names = [int(r["item"]) for r in got]
    assert len(names) == len(set(names)) == 8 and not set(names) & {10, 11, 20, 30}
    hard = {int(r["item"]) for r in got if r["kind"] == "hard"}
    assert hard == {21, 22, 23, 24, 25}


def test_stage1_fallback_and_known_never_recommended(spark, tables):
    w = Workspace(tables.hobbies, tables.demographics.where("sex = '여자'"))
    rows = w.reranked
    assert rows.join(w.train, ["uuid", "item"], "left_semi").isEmpty()
    lonely = rows.where(~F.col("has_context")).select((F.col("score") - F.round(features.stage1_score(), 9)).alias("d"))
    assert lonely.where(F.abs("d") > 0).isEmpty() and not lonely.isEmpty()
    ranks = rows.groupBy("uuid").agg(F.max("rnk").alias("m"), F.count("*").alias("n"))
    assert ranks.where("m <> n").isEmpty()
