"""Hard-negative mining against its definition."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from popgraph.llm import bond
from popgraph.llm.common import kept, numbered, prepare

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, row int, id int, vector int, rank int"
COLUMNS = ["anchor", "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def hard_rows(seed=5, n=260, width=12):
    """Copies, ties, repeated and null ids, null labels and vectors, broken and short vectors."""
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.1, 0.4) for _ in range(width)], rng.choice([0, 0, 0, 1, 2, -1])) for i in range(n)]
    rows += [(n + i, rows[3][1], i % 3) for i in range(30)]
    rows += [(3, rows[3][1], 0), (None, rows[5][1], 0), (None, rows[6][1], 1), (900, rows[7][1], None), (901, None, 0)]
    rows += [(902, [0.1, None] + [0.0] * (width - 2), 0), (903, [float("nan")] * width, 1), (904, [float("inf")] * width, 1), (905, [], 1), (906, [0.5, 0.5], 0)]
    rows += [(910, [0.0] * width, 7), (920, [-x for x in rows[3][1]], 0), (930, [1000.0] * width, 2), (931, [-1000.0] * width, 2)]
    rng.shuffle(rows)
    return [(*r, "x", 1, 2, 3, 4) for r in rows]


@pytest.mark.parametrize("block_rows", [1000, 37])
def test_mine_equals_definition(spark, block_rows):
    prepare(spark)
    table = kept(spark.createDataFrame(hard_rows(), SCHEMA).repartition(3), "vectors")
    got = bond.mine(table, "vec_id", "embedding", "label", F.col("vec_id") % 10 == 0, block_rows=block_rows).select(*COLUMNS).collect()
    stored = [r.asDict() for r in numbered(table).orderBy("__row").collect()]
    places = {r["__row"]: i for i, r in enumerate(stored)}
    want = brute.hard_negatives([(r["vec_id"], r["embedding"], r["label"], r["vec_id"] is not None and r["vec_id"] % 10 == 0) for r in stored])
    assert len(want) > 300
    assert sorted(((places[r[0]], *r[1:]) for r in got), key=str) == sorted(want, key=str)


def test_mine_without_rows(spark):
    prepare(spark)
    table = kept(spark.createDataFrame(hard_rows(), SCHEMA).where("false"), "vectors")
    assert bond.mine(table, "vec_id", "embedding", "label", F.col("vec_id") % 10 == 0).collect() == []
    table = kept(spark.createDataFrame(hard_rows(), SCHEMA), "vectors")
    assert bond.mine(table, "vec_id", "embedding", "label", F.lit(None).cast("boolean")).collect() == []


def test_scan_reads_large_components_first_and_drops_rows():
    rng = np.random.default_rng(1)
    block = object.__new__(bond.Block)
    block.columns = rng.integers(-5, 6, (64, 500)).astype(float)
    block.low, block.high = block.columns.min(axis=1), block.columns.max(axis=1)
    anchor = np.zeros(64)
    anchor[[40, 41, 50]] = 1000, -900, 800
    looks = []

    def drop(low, high):
        looks.append(len(low))
        return high < np.partition(low, len(low) - 5)[len(low) - 5]

    alive, score = bond.scan(anchor, block, np.arange(500), drop)
    exact = anchor @ block.columns
    assert looks[0] == 500 and looks[1] < 60
    assert set(np.flatnonzero(exact >= np.sort(exact)[-5])) <= set(alive) and (score == exact[alive]).all()


def test_scores_beyond_doubles_are_exact(spark):
    prepare(spark)
    big = [65535.9, 65530.1, -65535.0]
    rows = [(0, big, 0), (1, [65535.0, 65535.0, -65535.0], 0), (2, [30000.3, 30000.1, 0.1], 1), (3, [30000.3, 30000.1, 0.2], 1)]
    table = kept(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), "vectors")
    got = bond.mine(table, "vec_id", "embedding", "label", F.col("vec_id") == 0).select(*COLUMNS[1:]).collect()
    assert [tuple(r) for r in got] == [w[1:] for w in brute.hard_negatives([(*r, r[0] == 0) for r in rows])]
