"""The text join moves few pairs and loses none."""

import itertools
from types import SimpleNamespace

import numpy as np

from popgraph.operators import leakage
from popgraph.plans.catalog import queries  # noqa: F401  registers the plans
from popgraph.plans.registry import PLANS


def test_texts_that_share_rare_words_only_are_not_moved_as_pairs(spark):
    rng = np.random.default_rng(1)
    common = [f"word{w}" for w in range(600)]
    rows = [("ab"[i % 2], i, " ".join([f"rare{r}" for r in range(4)] + list(rng.choice(common, 100, replace=False)))) for i in range(120)]
    rows += [("b", 1000 + i, rows[2 * i][2] + " more") for i in range(20)]
    pairs, _ = leakage.candidate_pairs(spark.createDataFrame(rows, "side string, key long, text string"), 0.8)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(2 * i, 1000 + i) for i in range(20)}  # of 60 x 80 that share them


def test_near_duplicates_of_long_texts_and_one_sided_words(spark):
    rng = np.random.default_rng(2)
    rows, base = [], [f"w{i}" for i in range(3000)]
    for i in range(24):
        t = list(rng.choice(base, 900 + 40 * (i % 5), replace=False))
        rows.append(("a", i, " ".join(t)))
        cut = list(t[int(rng.integers(0, 120)):]) + [f"only{i}-{j}" for j in range(int(rng.integers(0, 110)))]
        rows.append(("b", i, " ".join(cut)))
    rows += [("a", 90, ""), ("b", 91, "  "), ("a", 92, None), ("b", 93, None), ("a", 94, "x"), ("b", 95, " x\n")]
    want = set()
    for x, y in itertools.product([r for r in rows if r[0] == "a"], [r for r in rows if r[0] == "b"]):
        p, q = set((x[2] or "").split()), set((y[2] or "").split())
        if p and q and len(p & q) / len(p | q) > 0.8:
            want.add((x[1], y[1], round(len(p & q) / len(p | q), 9)))
    df = spark.createDataFrame(rows, "side string, key long, text string")
    got = {(r["a"], r["b"], round(r["jaccard"], 9)) for r in leakage.near_duplicates(df).collect()}
    assert got == want and 5 < len(want) < 25


def test_communities_read_the_neighbour_table_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")]
    similar = spark.createDataFrame(pairs, "src string, dst string").mapInPandas(counted, "src string, dst string")
    got = PLANS["GA07_communities"](SimpleNamespace(similar=similar)).collect()
    assert {r["node"] for r in got} == set("abcxy") and read.value == len(pairs)
