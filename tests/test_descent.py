"""Neighbour descent against exact neighbours."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from popgraph.operators import descent, knn
from popgraph.operators import vector_index as vi


def test_recall_and_every_row_covered(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (12, 16))
    rows = [(f"v{i:04d}", [float(x) for x in centres[i % 12] + rng.normal(0, 0.6, 16)]) for i in range(600)] + [("copy", [1.0] * 16), ("copy2", [1.0] * 16)]
    vectors = spark.createDataFrame(rows, "uuid string, embedding array<double>")
    found = descent.descend(vectors, 5, pool=20).cache()
    exact = knn.neighbours(vectors, 5)
    as_hits = [x.select(F.col("src").alias("query"), F.col("dst").alias("uuid")) for x in (found, exact)]
    got = vi.recall(*as_hits).first()
    assert got["queries"] == 602 and got["recall"] >= 0.9
    assert found.count() == 602 * 5 and found.where("src = dst").isEmpty()
    scores = {(r["src"], r["dst"]): r["score"] for r in exact.collect()}
    assert all(scores.get((r["src"], r["dst"]), r["score"]) == r["score"] for r in found.collect())


def test_few_vectors(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.5]), ("c", [0.0, 0.0])], "uuid string, embedding array<double>")
    rows = {(r["src"], r["rnk"], r["dst"]) for r in descent.descend(vectors, 5).collect()}
    assert len(rows) == 6 and ("a", 1, "b") in rows
    assert descent.descend(vectors.where("false"), 5).collect() == []


def test_a_centre_split_over_batches_meets_once():
    rng = np.random.default_rng(8)
    v = rng.normal(0, 1, (40, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = pa.table({
        "centre": pa.array([1] * 15 + [2] * 25, pa.int64()), "id": pa.array(list(range(15)) + list(range(25)), pa.int64()),
        "is_new": pa.array([i % 3 == 0 for i in range(40)]), "worst": pa.array([0.1] * 40), "m": pa.array([x.tobytes() for x in v], pa.binary()),
    })
    def met(size):
        return sorted(r for b in descent._meet(iter(rows.to_batches(max_chunksize=size)), 5) for r in zip(*(c.to_pylist() for c in b.columns)))

    want = []
    for lo, hi in ((0, 15), (15, 40)):
        for a in range(lo, hi):
            wins = [(-round(float(v[a] @ v[b]), 9), b - lo) for b in range(lo, hi) if a != b and (a % 3 == 0 or b % 3 == 0) and v[a] @ v[b] > 0.1]
            want += [(a - lo, b, -s) for s, b in sorted(wins)[:5]]
    assert met(40) == met(7) == met(1) == sorted(want)
