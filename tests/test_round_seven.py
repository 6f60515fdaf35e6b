"""Queries that once did part of their job only, and steps that moved or held too much."""

import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from popgraph.operators import algorithms as algo
from popgraph.operators import blocks, diversity, leakage, ranker, vector_index
from popgraph.operators.blocks import BlockGraph
from popgraph.plans import learning_plans  # noqa: F401
from popgraph.plans.registry import PLANS


def test_negative_search_tries_every_setting(spark, monkeypatch):
    """Four ratios, then three hardness values at the best one, with trees that end by validation; no setting is fitted twice."""
    pairs = spark.createDataFrame([("u", "i")], "uuid string, item string")
    w = SimpleNamespace(part=lambda name: pairs, pool=pairs, train=pairs, split=pairs, item_profile=None, pool_features=pairs)
    asked, fits = [], []
    monkeypatch.setattr(ranker, "datasets", lambda *a, **k: asked.extend(a[6]) or pairs)
    monkeypatch.setattr(ranker, "one_dataset", lambda every, r, h: every.withColumn("at", F.lit(r % 5 + h)))
    monkeypatch.setattr(ranker, "fit", lambda data, columns, params: fits.append(params) or data.first()["at"])
    monkeypatch.setattr(ranker, "recall_of", lambda model, *a: float(model))
    rows = PLANS["ML05_negative_search"](SimpleNamespace(reco=w, demographics=None)).collect()
    assert [tuple(r)[:3] for r in rows] == [("ratio", n, 0.8) for n in (1, 2, 4, 8)] + [("hardness", 4, h) for h in (0.5, 0.8, 1.0)]
    assert set(asked) == {(r, h) for r in (1, 2, 4, 8) for h in (0.5, 0.8, 1.0)} and len(fits) == 6
    assert fits[0]["maxIter"] == 500 and fits[0]["maxDepth"] == 4


def cosines(texts):
    """All words' TF-IDF cosines between the sides, text by text."""
    bags = [(s, Counter((t or "").lower().split())) for s, _, t in texts]
    df = Counter(w for _, b in bags for w in b)
    unit = []
    for s, b in bags:
        v = {w: n * math.log((len(bags) + 1) / (df[w] + 1)) for w, n in b.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        unit.append((s, {w: x / length for w, x in v.items()} if length else {}))
    return [sum(x * b.get(w, 0.0) for w, x in a.items()) for s, a in unit if s == "a" for z, b in unit if z == "b"]


def test_text_overlap_uses_every_word(spark):
    """More words than the 50 commonest, copies, texts without words and a heaviest pair that no rare word points at."""
    rng = random.Random(4)
    for seen in range(4):
        texts = [("ab"[rng.random() < 0.4], i, " ".join(f"W{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(1, 40)))) for i in range(50)]
        texts += [("a", 90, None), ("b", 91, ""), ("a", 92, texts[0][2]), ("a", 92, texts[0][2])]
        texts += [("b", 93, texts[0][2])] * (seen == 3)
        want = cosines(texts)
        got = leakage.tfidf_overlap(spark.createDataFrame(texts, "side string, key int, text string")).first()
        assert abs(got["mean_cosine"] - sum(want) / len(want)) < 1e-9 and abs(got["max_cosine"] - max(want)) < 1e-8
    assert max(want) > 1 - 1e-9


def test_largest_cosine_is_searched_behind_the_guess(spark, monkeypatch):
    """Without any known pair to start from, the search alone finds the largest cosine."""
    monkeypatch.setattr(leakage, "GUESS_WORDS", 0)
    rng = random.Random(5)
    texts = [("ab"[i % 2], i, " ".join(f"w{rng.randrange(60)}" for _ in range(12))) for i in range(60)]
    got = leakage.tfidf_overlap(spark.createDataFrame(texts, "side string, key int, text string")).first()
    assert abs(got["max_cosine"] - max(cosines(texts))) < 1e-8


def test_reranking_takes_many_lists_at_once(spark, monkeypatch):
    """Lists of one length are reranked together, with the picks of one list at a time; no group is handed over as pandas."""
    rng, many = np.random.default_rng(8), diversity.greedy_mmr_many
    monkeypatch.setattr(diversity, "AT_ONCE", 3)
    vectors = {f"i{i:02d}": (np.eye(5)[rng.integers(0, 5)] if i % 7 else np.zeros(5)).tolist() for i in range(30)}
    rows, want, dpp = [], set(), set()
    for u in range(25):
        picks = rng.permutation(30)[: 1 + u % 4 * 6]
        own = [(f"u{u}", f"i{i:02d}", float(rng.integers(0, 4)) / 4, n + 1) for n, i in enumerate(picks)]
        rows += own
        s, v = np.array([r[2] for r in own]), np.array([vectors[r[1]] for r in own])
        want |= {(f"u{u}", own[i][1], own[i][2], n + 1) for n, i in enumerate(diversity.greedy_mmr(s, v, 0.5, 10))}
        dpp |= {(f"u{u}", own[i][1], own[i][2], n + 1) for n, i in enumerate(diversity.greedy_dpp(s, v, 0.5, 10))}
    lists = spark.createDataFrame(rows, "uuid string, item string, score double, rnk int")
    items = spark.createDataFrame(list(vectors.items()), "item string, embedding array<double>")
    reranked = diversity.mmr(lists, items, 0.5, 10)
    assert "FlatMapGroups" not in reranked._jdf.queryExecution().toString()
    assert {tuple(r) for r in reranked.collect()} == want and {tuple(r) for r in diversity.dpp(lists, items, 0.5, 10).collect()} == dpp
    scores, held = np.array([[0.9, 0.8, 0.8], [0.1, 0.2, 0.2]]), np.stack([np.eye(3)[[0, 0, 1]]] * 2)
    assert many(scores, held, 0.5, 2).tolist() == [diversity.greedy_mmr(s, v, 0.5, 2) for s, v in zip(scores, held)]


def test_sliced_neighbour_sums(spark):
    """Vectors cut into slices give the sums of whole vectors, and a pass moves no edge."""
    rng, n, dim = np.random.default_rng(9), 24, 7
    links = {(int(a), int(b)) for a, b in rng.integers(0, n, (60, 2)) if a != b} | {(0, i) for i in range(1, n)}
    rows = [(str(x), str(y)) for a, b in sorted(links) for x, y in ((a, b), (b, a))]
    start = {str(i): (rng.normal(size=dim) if i % 5 else np.zeros(dim)) for i in range(n)}
    adj = spark.createDataFrame(rows, "src string, dst string")
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in start.items()], "node string, v array<double>")
    got = []
    for width in (7, 3):
        g = BlockGraph(adj, dim, piece_edges=9, into_edges=20, block_rows=5, width=width)
        first = g.sums(g.packed(frame))
        assert len(first.slices) == -(-dim // width)
        out = g.unpacked([(2.0, first), (0.5, g.sums(first))]).collect()
        got.append({r["node"]: np.array(r["embedding"]) for r in out})
    assert set(got[0]) == set(start)
    assert all(np.allclose(got[0][k], other[k], atol=1e-12) for other in got[1:] for k in start)
    one = {k: sum((start[a] for a, b in rows if b == k), np.zeros(dim)) for k in start}
    one = {k: v / np.linalg.norm(v) for k, v in one.items()}
    two = {k: sum((one[a] for a, b in rows if b == k), np.zeros(dim)) for k in start}
    assert all(np.allclose(got[0][k], 2 * one[k] + 0.5 * two[k] / np.linalg.norm(two[k])) for k in start)


def test_a_large_graph_is_cut_into_slices(spark, monkeypatch):
    adj = spark.createDataFrame([(str(a), str(b)) for a, b in ((0, 1), (1, 0), (1, 2), (2, 1))], "src string, dst string")
    assert len(BlockGraph(adj, 96).cuts) == 1
    monkeypatch.setattr(blocks, "PASS_BYTES", 4 * 96 * 8 // 2)
    assert BlockGraph(adj, 96).cuts == [(0, 48), (48, 48)]
    monkeypatch.setattr(blocks, "PASS_BYTES", 1)
    assert BlockGraph(adj, 96).cuts == [(0, 32), (32, 32), (64, 32)]
    wide = {r["node"]: r["embedding"] for r in algo.fastrp(adj, 96).collect()}
    monkeypatch.setattr(blocks, "PASS_BYTES", 1 << 30)
    assert all(np.allclose(wide[r["node"]], r["embedding"]) for r in algo.fastrp(adj, 96).collect())


def test_queries_of_an_index_are_listed_piece_by_piece(monkeypatch):
    """A batch of queries never becomes a row per query and list at once."""
    rng = np.random.default_rng(10)
    model = vector_index.Model(rng.normal(size=(12, 4)), [])
    batch = pd.DataFrame({"query": [f"q{i}" for i in range(50)], "embedding": rng.normal(size=(50, 4)).tolist()})
    whole = pd.concat(vector_index._asked(iter([batch, batch[:0]]), model, 8), ignore_index=True)
    monkeypatch.setattr(vector_index, "ASKED_ROWS", 100)
    pieces = list(vector_index._asked(iter([batch, batch[:0]]), model, 8))
    assert max(map(len, pieces)) <= 100 and len(whole) == 400
    cut = pd.concat(pieces, ignore_index=True)
    assert cut[["query", "list"]].equals(whole[["query", "list"]]) and np.allclose(np.stack(cut["v"]), np.stack(whole["v"]))
