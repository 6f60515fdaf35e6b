"""Diversity reranking of candidate lists (at most a pool of rows per person) and list diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popgraph.functions.skew import join_measured
from popgraph.operators import metrics
from popgraph.session import cut_lineage

LIST_SCHEMA = "uuid string, item string, score double, rnk int"


def greedy_mmr(scores: np.ndarray, vectors: np.ndarray, lam: float, k: int) -> list[int]:
    """Positions chosen one by one: lam * score - (1 - lam) * largest similarity to those chosen."""
    sims = vectors @ vectors.T
    closest = np.zeros(len(scores))
    free = np.ones(len(scores), dtype=bool)
    chosen: list[int] = []
    for step in range(min(k, len(scores))):
        value = np.round(lam * scores - (1 - lam) * closest, 12)
        value[~free] = -np.inf
        tied = np.flatnonzero(value == value.max())
        pick = int(tied[np.argmax(scores[tied])])
        chosen.append(pick)
        free[pick] = False
        closest = sims[pick].copy() if step == 0 else np.maximum(closest, sims[pick])
    return chosen


def greedy_mmr_each(scores: np.ndarray, vectors: np.ndarray, lambdas: np.ndarray, k: int) -> np.ndarray:
    """`greedy_mmr` for several lambdas at once: one row of positions per lambda."""
    sims = vectors @ vectors.T
    closest = np.zeros((len(lambdas), len(scores)))
    free = np.ones(closest.shape, dtype=bool)
    chosen = np.empty((len(lambdas), min(k, len(scores))), dtype=int)
    relevance, every = lambdas[:, None] * scores, np.arange(len(lambdas))
    for step in range(chosen.shape[1]):
        value = np.where(free, np.round(relevance - (1 - lambdas)[:, None] * closest, 12), -np.inf)
        pick = np.where(value == value.max(axis=1)[:, None], scores, -np.inf).argmax(axis=1)
        chosen[:, step], free[every, pick] = pick, False
        closest = sims[pick] if step == 0 else np.maximum(closest, sims[pick])
    return chosen


def greedy_mmr_many(scores: np.ndarray, vectors: np.ndarray, lam: float, k: int) -> np.ndarray:
    """`greedy_mmr` for several lists of one length at once: scores (lists, n), vectors (lists, n, dimensions)."""
    sims = vectors @ vectors.transpose(0, 2, 1)
    closest = np.zeros(scores.shape)
    free = np.ones(scores.shape, dtype=bool)
    chosen = np.empty((len(scores), min(k, scores.shape[1])), dtype=int)
    every = np.arange(len(scores))
    for step in range(chosen.shape[1]):
        value = np.where(free, np.round(lam * scores - (1 - lam) * closest, 12), -np.inf)
        pick = np.where(value == value.max(axis=1)[:, None], scores, -np.inf).argmax(axis=1)
        chosen[:, step], free[every, pick] = pick, False
        closest = sims[every, pick] if step == 0 else np.maximum(closest, sims[every, pick])
    return chosen


def greedy_dpp(scores: np.ndarray, vectors: np.ndarray, theta: float, k: int) -> list[int]:
    """Greedy log-determinant maximisation by incremental Cholesky updates."""
    n = len(scores)
    spread = scores.max() - scores.min()
    rel = np.ones(n) if spread == 0 else (scores - scores.min()) / spread
    alpha = float(np.clip(theta, 0.0, 1.0))
    sims = np.clip(np.nan_to_num(vectors @ vectors.T), -1.0, 1.0)
    kernel = alpha * (sims + 1) / 2 + (1 - alpha) * np.outer(rel, rel) + 1e-6 * np.eye(n)
    gain = np.diag(kernel).copy()
    rows = np.zeros((min(k, n), n))
    free = np.ones(n, dtype=bool)
    chosen: list[int] = []
    for step in range(min(k, n)):
        value = np.where(free, gain, -np.inf)
        pick = int(value.argmax())
        chosen.append(pick)
        free[pick] = False
        pivot = max(gain[pick], 1e-12)
        rows[step] = (kernel[pick] - rows[:step, pick] @ rows[:step]) / np.sqrt(pivot)
        gain = gain - rows[step] ** 2
    return chosen


AT_ONCE = 128  # lists whose similarities are held at a time


def _held(lists: DataFrame, vectors: DataFrame) -> DataFrame:
    """(uuid, items, scores, vectors): a person's rows by rank, the vectors end to end."""
    rows = join_measured(lists.select("uuid", "item", "score", "rnk"), vectors.select("item", "embedding"), "item", "uuid")
    held = rows.groupBy("uuid").agg(F.sort_array(F.collect_list(F.struct("rnk", "item", "score", "embedding"))).alias("rows"))
    return held.select(
        "uuid", F.col("rows.item").alias("items"), F.col("rows.score").cast("array<double>").alias("scores"),
        F.flatten(F.col("rows.embedding")).cast("array<double>").alias("vectors"),
    )


def _rerank(lists: DataFrame, vectors: DataFrame, choose) -> DataFrame:
    """Lists in the order of `choose`, which gets several lists of one length: scores (lists, n) and vectors (lists, n, d).

    A task goes through persons in Arrow batches, AT_ONCE lists of one length together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, scores, parts = (batch.column(c) for c in ("items", "scores", "vectors"))
            starts, s_at, v_at = (c.offsets.to_numpy() for c in (items, scores, parts))
            s, v = (c.values.to_numpy(zero_copy_only=False) for c in (scores, parts))
            sizes, dims = np.diff(starts), np.diff(v_at)
            for n, d in {(int(n), int(d)) for n, d in zip(sizes, dims) if n}:
                people = np.flatnonzero((sizes == n) & (dims == d))
                for at in range(0, len(people), AT_ONCE):
                    some = people[at : at + AT_ONCE]
                    mine = s[s_at[some][:, None] + np.arange(n)]
                    chosen = choose(mine, v[v_at[some][:, None] + np.arange(d)].reshape(len(some), n, -1))
                    k = chosen.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("uuid").take(pa.array(np.repeat(some, k))), items.values.take(pa.array((starts[some][:, None] + chosen).ravel())),
                         pa.array(np.take_along_axis(mine, chosen, axis=1).ravel()), pa.array(np.tile(np.arange(1, k + 1), len(some)), pa.int32())],
                        names=["uuid", "item", "score", "rnk"],
                    )

    return _held(lists, vectors).mapInArrow(run, LIST_SCHEMA)


def mmr(lists: DataFrame, vectors: DataFrame, lam: float = 0.7, k: int = 10) -> DataFrame:
    return _rerank(lists, vectors, lambda s, v: greedy_mmr_many(s, v, lam, k))


def mmr_each(lists: DataFrame, vectors: DataFrame, lambdas, k: int = 10) -> DataFrame:
    """(at, uuid, item, rnk): the list that `mmr` makes of every person's rows for the lambda at each position.

    A person's rows meet once for all lambdas, and a task goes through persons in Arrow batches.
    """
    wanted = np.array(lambdas, dtype="float64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, person, item, rnk = [], [], [], []
            items, scores, parts = (batch.column(c) for c in ("items", "scores", "vectors"))
            starts = items.offsets.to_numpy()
            s, v = (c.values.to_numpy(zero_copy_only=False) for c in (scores, parts))
            s_at, v_at = scores.offsets.to_numpy(), parts.offsets.to_numpy()
            for i in range(batch.num_rows):
                n = starts[i + 1] - starts[i]
                chosen = greedy_mmr_each(s[s_at[i] : s_at[i + 1]], v[v_at[i] : v_at[i + 1]].reshape(n, -1), wanted, k)
                item.append(starts[i] + chosen.ravel())
                at.append(np.repeat(np.arange(len(wanted)), chosen.shape[1]))
                rnk.append(np.tile(np.arange(1, chosen.shape[1] + 1), len(wanted)))
                person.append(np.full(chosen.size, i))
            if person:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(at), pa.int32()), batch.column("uuid").take(pa.array(np.concatenate(person))),
                     items.values.take(pa.array(np.concatenate(item))), pa.array(np.concatenate(rnk), pa.int32())],
                    names=["at", "uuid", "item", "rnk"],
                )

    return _held(lists, vectors).mapInArrow(run, "at int, uuid string, item string, rnk int")


def dpp(lists: DataFrame, vectors: DataFrame, theta: float = 0.5, k: int = 10) -> DataFrame:
    return _rerank(lists, vectors, lambda s, v: np.array([greedy_dpp(a, b, theta, k) for a, b in zip(s, v)]))


def list_diversity(lists: DataFrame, vectors: DataFrame, dim: int, k: int) -> DataFrame:
    """1 - mean pairwise similarity per person; lists of one item have diversity 1.

    The sum over pairs follows from the summed vector: (|sum|^2 - sum of |v|^2) / 2.
    """
    rows = lists.where(F.col("rnk") <= k).join(vectors.select("item", "embedding"), "item")
    parts = rows.groupBy("uuid").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.get("embedding", F.lit(i))).alias(f"s{i}") for i in range(dim)],
        F.sum(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("own"),
    )
    total = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(dim)), F.lit(0.0))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = (total - F.col("own")) / 2 / pairs
    return parts.select("uuid", F.when(F.col("n") >= 2, 1 - mean).otherwise(1.0).alias("diversity"))


def lambda_sweep(lists, vectors, truth, n_items, pop, categories, lambdas, k: int = 10) -> DataFrame:
    """Metrics at k for every lambda next to the unchanged order, with deltas."""
    judged = metrics.evaluated(truth, lists)  # the metrics read no other persons
    # each summary is worked out once; its few rows meet the base's
    base = cut_lineage(metrics.summary(truth, judged.where(F.col("rnk") <= k), n_items, pop, categories, ks=(k,)))
    ranked = cut_lineage(mmr_each(judged, vectors, lambdas, k))
    out = None
    for i, lam in enumerate(lambdas):
        now = cut_lineage(metrics.summary(truth, ranked.where(F.col("at") == i), n_items, pop, categories, ks=(k,)))
        rows = metrics.deltas(base, now).withColumn("lam", F.lit(float(lam)))
        out = rows if out is None else out.unionByName(rows)
    return out


def best_lambda(sweep: DataFrame, max_drop: float = 0.002) -> DataFrame:
    """Lambda with the largest coverage and diversity gain among those that keep recall and gain twice."""
    def d(m):
        return F.max(F.when(F.col("metric") == m, F.col("delta")))

    per = sweep.groupBy("lam").agg(
        d("recall").alias("recall"), d("catalog_coverage").alias("coverage"), d("novelty").alias("novelty"), d("intra_list_diversity").alias("ild")
    )
    gains = sum(((F.col(c) > 0).cast("int") for c in ("coverage", "novelty", "ild")), F.lit(0))
    ok = (F.col("recall") >= -max_drop) & (gains >= 2)
    score = F.when(ok, F.round(F.col("coverage") + F.col("ild"), 9))
    ranked = per.withColumn("gains", gains).withColumn("score", score)
    best = Window.orderBy(F.desc_nulls_last("score"), F.asc("lam"))
    return ranked.withColumn("chosen", (F.row_number().over(best) == 1) & F.col("score").isNotNull())
