"""Approximate nearest neighbours by descent: neighbours of neighbours are likely neighbours.

Every vector starts with the best of two random groups. In a round each vector brings together its `pool` neighbours and a
sample of those that have it as a neighbour; pairs of them with at least one entry that is new since the last round are
compared, and what beats a list's last entry goes to that list. Rounds end when no more than `delta` of all entries
changed. All vectors take part in every round. A round's work per vector is bounded by `pool`, so it grows with the
number of vectors; reverse lists are cut to a sample in every task before they are shuffled, so a vector that many have as
their neighbour makes no large group. `knn.neighbours` is the exact form.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popgraph.functions.skew import dense_index
from popgraph.operators.knn import _best, _matrix, _unit
from popgraph.sources.files import stored

GROUP_ROWS = 64
STARTS = 2
PAIRS = "src long, dst long, score double"
MAX_PAIRS = 1 << 18  # pairs that a task returns at a time


def _first(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def _lists(rows: DataFrame, pool: int) -> DataFrame:
    """The best `pool` entries of every src; an entry that was there before is not new."""
    once = rows.repartition("src").groupBy("src", "dst").agg(F.max("score").alias("score"), F.min("is_new").alias("is_new"))
    return stored(_first(once, "src", [F.desc("score"), F.asc("dst")], pool))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            unit = _unit(_matrix(batch.column("embedding").to_pandas()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v.tobytes() for v in unit], pa.binary())], names=["id", "m"])


def _vectors(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), "float64").reshape(len(column), -1)


def _in_group(pdf: pd.DataFrame, pool: int) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    ids, v = pdf["id"].to_numpy(), _vectors(pdf["m"].tolist())
    scores = np.round(v @ v.T, 9)
    np.fill_diagonal(scores, -np.inf)
    best = _best(scores, ids, min(pool, len(ids) - 1))
    return pd.DataFrame({"src": np.repeat(ids, best.shape[1]), "dst": ids[best].ravel(), "score": np.take_along_axis(scores, best, axis=1).ravel()})


def _among(ids: np.ndarray, new: np.ndarray, worst: np.ndarray, v: np.ndarray, pool: int) -> tuple:
    """Pairs of one vector's members, sorted by id, that beat the last entry of their list: `pool` at most for each."""
    scores = np.round(v @ v.T, 9)
    np.fill_diagonal(scores, -np.inf)
    wins = (new[:, None] | new[None, :]) & (scores > worst[:, None])
    if len(ids) > pool and wins.sum(axis=1).max() > pool:
        best = _best(np.where(wins, scores, -np.inf), ids, pool)
        kept = np.zeros_like(wins)
        np.put_along_axis(kept, best, True, axis=1)
        wins &= kept
    a, b = np.nonzero(wins)
    return ids[a], ids[b], scores[a, b]


def _meet(batches: Iterator[pa.RecordBatch], pool: int) -> Iterator[pa.RecordBatch]:
    """Rows (centre, id, is_new, worst, m) in the order of centres: the winning pairs of every centre's members."""

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        centre, ids, new, worst = (rows.column(c).to_numpy() for c in ("centre", "id", "is_new", "worst"))
        v, out, held = _vectors(rows.column("m").to_pylist()), [], 0
        starts = np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1]]))
        for a, b in zip(starts, np.append(starts[1:], len(centre))):
            out.append(_among(ids[a:b], new[a:b], worst[a:b], v[a:b], pool))
            held += len(out[-1][0])
            if held > MAX_PAIRS:
                yield _batch(out)
                out, held = [], 0
        if held:
            yield _batch(out)

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        centre = rows.column("centre").to_numpy()
        last = int(np.searchsorted(centre, centre[-1]))
        if last:
            yield from pairs(rows.slice(0, last))
        rest = rows.slice(last)
    if rest is not None:
        yield from pairs(rest)


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["src", "dst", "score"])


def descend(
    vectors: DataFrame, k: int, pool: int | None = None, sample_rate: float = 1.0, delta: float = 1e-3, max_rounds: int = 15
) -> DataFrame:
    """(src, dst, score, rnk): about the k nearest neighbours by cosine of every vector of (uuid, embedding).

    `pool` entries are kept per vector on the way (default 4 k); more of them find more. `sample_rate` is the share of a
    pool that a round looks at. Ids must be unique; a vector has fewer than k neighbours only if there are fewer others.
    Inside, vectors go by numbers in the order of their ids.
    """
    pool = max(k, pool or 4 * k)
    given = vectors.select(F.col("uuid").cast("string"), F.col("embedding").cast("array<double>"))
    names = stored(dense_index(given.select("uuid").distinct(), ["uuid"], "id"))
    numbered = given.join(names.withColumnRenamed("uuid", "__uuid"), F.col("uuid").eqNullSafe(F.col("__uuid")))
    own = stored(numbered.select("id", "embedding").mapInArrow(_units, "id long, m binary"))
    n, cap = own.count(), max(1, math.ceil(pool * sample_rate))
    groups = max(1, round(n / max(GROUP_ROWS, 2 * pool)))
    starts = own.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(STARTS if groups > 1 else 1))))
    starts = starts.withColumn("group", F.pmod(F.xxhash64("id", "start"), F.lit(groups)))
    found = starts.groupBy("start", "group").applyInPandas(lambda pdf: _in_group(pdf, pool), PAIRS)
    lists = _lists(found.withColumn("is_new", F.lit(True)), pool)
    for i in range(max_rounds):
        order = [F.desc("is_new"), F.asc(F.xxhash64("id", F.lit(i))), F.asc("id")]
        near = lists.select(F.col("src").alias("centre"), F.col("dst").alias("id"), "is_new")
        back = lists.select(F.col("dst").alias("centre"), F.col("src").alias("id"), "is_new")
        members = _first(near, "centre", order, cap).unionByName(_first(back, "centre", order, cap))
        members = members.groupBy("centre", "id").agg(F.max("is_new").alias("is_new"))
        last = lists.groupBy(F.col("src").alias("id")).agg(F.when(F.count(F.lit(1)) >= pool, F.min("score")).otherwise(F.lit(-2.0)).alias("worst"))
        held = own.join(last, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
        rows = members.join(held, "id").select("centre", "id", "is_new", "worst", "m").repartition("centre")
        met = rows.sortWithinPartitions("centre", "id").mapInArrow(lambda batches: _meet(batches, pool), PAIRS)
        old = lists.withColumn("is_new", F.lit(False))
        lists = _lists(old.unionByName(met.withColumn("is_new", F.lit(True))), pool)
        if lists.where("is_new").count() <= delta * n * pool:
            break
    w = Window.partitionBy("src").orderBy(F.desc("score"), F.asc("dst"))
    top = lists.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)
    for side in ("src", "dst"):
        top = top.join(names.select(F.col("id").alias(side), F.col("uuid").alias(f"{side}_name")), side)
    return top.select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "score", "rnk")
