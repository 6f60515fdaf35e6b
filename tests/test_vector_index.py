"""The stored index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from popgraph.operators import knn
from popgraph.operators import vector_index as vi
from popgraph.sources.files import scratch_path


@pytest.fixture(scope="module")
def stored(spark):
    rng = np.random.default_rng(4)
    rows = [(str(i), [float(x) for x in rng.normal(0.2, 1, 24)]) for i in range(900)]
    rows += [("copy1", rows[5][1]), ("copy2", rows[5][1]), ("zero", [0.0] * 24)]
    vectors = spark.createDataFrame(rows, "uuid string, embedding array<double>").repartition(3).cache()
    path = scratch_path(spark, "index")
    vi.write_index(vectors, path, vi.fit(vectors, n_lists=20, n_parts=6))
    queries = vectors.where("try_cast(uuid AS INT) % 30 = 0").select(F.col("uuid").alias("query"), "embedding")
    return vectors, path, queries


def rows_of(df):
    return sorted((r["query"], r["rnk"], r["uuid"], r["score"]) for r in df.collect())


def test_all_lists_equal_exact_search(spark, stored):
    vectors, path, queries = stored
    exact = rows_of(knn.search(vectors, queries, 7))
    assert rows_of(vi.search_index(spark, path, queries, 7)) == exact
    assert rows_of(vi.search_index(spark, path, queries, 7, block_rows=16, query_rows=5)) == exact


def test_probed_lists_and_codes_keep_recall(spark, stored):
    vectors, path, queries = stored
    exact = knn.search(vectors, queries, 5)
    found = vi.search_index(spark, path, queries, 5, n_probe=14, rerank=40)
    got = vi.recall(found, exact).first()
    assert got["queries"] == 30 and got["recall"] >= 0.9
    few = vi.recall(vi.search_index(spark, path, queries, 5, n_probe=1, rerank=10), exact).first()["recall"]
    assert 0.1 < few < got["recall"]


def test_only_probed_partitions_are_read(spark, stored):
    vectors, path, queries = stored
    plan = vi.search_index(spark, path, queries.limit(1), 3, n_probe=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_every_row_is_indexed_once(spark, stored):
    vectors, path, queries = stored
    rows = spark.read.parquet(f"{path}/vectors")
    assert rows.count() == rows.select("uuid").distinct().count() == vectors.count()
    assert vi.search_index(spark, path, queries.where("false"), 3).collect() == []
    with pytest.raises(ValueError):
        vi.fit(vectors.where("false"))
