"""One ranking of negatives for all settings; neighbour sums without a vector per edge; few scores held at a time."""

from __future__ import annotations


import numpy as np
import pyarrow as pa

from popgraph.operators import knn, ranker
from popgraph.operators.blocks import BlockGraph

SETTINGS = [(1, 0.8), (1, 0.5), (4, 0.8), (4, 0.5), (3, 1.0)]


def pairs(spark, rows):
    return spark.createDataFrame([(str(u), str(i)) for u, i in rows], "uuid string, item string")


def test_every_setting_is_a_prefix_of_one_draw(spark):
    pos = pairs(spark, [(1, 10), (1, 11), (2, 12), (3, 40), (3, 40)])
    pool = pairs(spark, [(1, i) for i in range(20, 26)] + [(2, 20), (2, 12), (4, 20)])
    known = pairs(spark, [(1, 30), (1, 20), (3, 1), (4, 2)])
    items = pairs(spark, [(0, i) for i in range(60)]).select("item")
    every = ranker.negative_ranks(pos, pool, known, items, SETTINGS)
    n, n_free = {"1": 2, "2": 1, "3": 1}, {"1": 5, "2": 1, "3": 0}
    rows = [r.asDict() for r in every.collect()]
    assert len({(r["uuid"], r["item"]) for r in rows}) == len(rows)
    for ratio, hardness in SETTINGS:
        got = ranker.drawn(every, ratio, hardness).select("uuid", "item", "kind").collect()
        alone = ranker.sample_negatives(pos, pool, known, items, ratio, hardness).collect()
        assert sorted(got) == sorted(alone)
        for u in n:
            hard = min(int(n[u] * ratio * hardness), n_free[u])
            assert sum(r["uuid"] == u and r["kind"] == "hard" for r in got) == hard
            assert sum(r["uuid"] == u and r["kind"] == "easy" for r in got) == n[u] * ratio - hard


def test_search_builds_features_once(spark, tables, monkeypatch):
    """The registered search asks for the features of its datasets once, not once a setting."""
    from popgraph.operators import features
    from popgraph.plans import learning_plans  # noqa: F401
    from popgraph.plans.registry import PLANS
    from popgraph.sources.tables import Tables

    calls, build = [], features.build
    monkeypatch.setattr(features, "build", lambda *a, **k: calls.append(1) or build(*a, **k))
    monkeypatch.setattr(ranker, "fit", lambda data, *a: data.count())
    monkeypatch.setattr(ranker, "recall_of", lambda model, *a: float(model))
    rows = PLANS["ML05_negative_search"](Tables(spark, tables.sf_dir)).collect()
    assert [(r["phase"], r["neg_ratio"]) for r in rows[:2]] == [("ratio", 1), ("ratio", 4)] and len(rows) == 3
    assert len(calls) == 2  # the pool's and the datasets'


def test_block_sums_against_numpy(spark):
    """Small blocks, pieces and salts give the sums of the whole adjacency; a repeated edge counts twice, a null end not."""
    rng, n, dim = np.random.default_rng(3), 30, 4
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (70, 2))] + [(0, i) for i in range(1, n)] + [(1, 2), (1, 2)]
    rows = [(str(x), str(y)) for a, b in pairs for x, y in ((a, b), (b, a))] + [("lost", None), (None, "lost")]
    start = {str(i): rng.normal(size=dim) for i in range(n)}
    adj = spark.createDataFrame(rows, "src string, dst string")
    g = BlockGraph(adj, dim, piece_edges=5, into_edges=7, block_rows=4)
    assert g.salts.agg({"n_salts": "max"}).first()[0] > 1 and g.edges.agg({"n_into": "max"}).first()[0] > 1
    first = g.packed(spark.createDataFrame([(k, v.tolist()) for k, v in start.items()], "node string, v array<double>"))
    second = g.sums(first)
    got = {r["node"]: np.array(r["embedding"]) for r in g.unpacked([(2.0, second), (1.0, g.sums(second))]).collect()}

    def step(vectors):
        out = {k: np.zeros(dim) for k in vectors}
        for a, b in rows[:-2]:
            out[b] = out[b] + vectors[a]
        return {k: v / np.linalg.norm(v) if v.any() else v for k, v in out.items()}

    one = step(start)
    two = step(one)
    assert set(got) == set(start)
    assert all(np.allclose(got[k], 2 * one[k] + two[k]) for k in start)


def test_neighbours_hold_few_scores_at_a_time(monkeypatch):
    """A pack meets another one by parts of at most MAX_ROUGH scores, with the same neighbours."""
    rng, n, k = np.random.default_rng(5), 40, 3
    v = rng.normal(size=(n, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, shapes, floor = pa.array([f"{i:02d}" for i in range(n)]), [], knn._Best._floor
    monkeypatch.setattr(knn, "MAX_ROUGH", 5 * n)
    monkeypatch.setattr(knn, "MAX_SCORED", 7)
    monkeypatch.setattr(knn._Best, "_floor", lambda self, rough, lo, hi: shapes.append(rough.size) or floor(self, rough, lo, hi))
    best = knn._Best((0, 0), ids, v, k)
    best.meet((0, 0), ids, v, knn.BLOCK_ROWS, True)
    assert max(shapes) <= 5 * n
    scores = np.round(v @ v.T, 9) - 9 * np.eye(n)
    want = {(f"{i:02d}", f"{j:02d}") for i in range(n) for j in np.argsort(-scores[i], kind="stable")[:k]}
    rows = best.rows()
    assert set(zip(rows.column("src").to_pylist(), rows.column("dst").to_pylist())) == want
