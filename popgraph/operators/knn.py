"""Cosine search: few queries against all vectors, and the exact nearest-neighbour table of all vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from popgraph.session import cut_lineage

MAX_QUERIES = 10_000
BLOCK_ROWS = 2048
SCORES = 1 << 23  # scores of a query batch that a task holds at a time
PACK_BYTES = 4 << 20  # unit vectors that travel as one row
SIDE_BYTES = 64 << 20  # packs of the inner side that one task reads
SINGLE_ERROR = 1e-5  # more than single precision and the rounding to nine digits can lose on unit vectors
FIRST_COLUMNS = 256
MAX_SCORED = 1 << 14  # pairs scored in full precision at a time
MAX_ROUGH = 1 << 21  # single-precision scores that a task holds at a time
NO_SCORE = -9.0  # stands for a score that is not a number: behind all others
PACK_SCHEMA = "part int, seq int, ids array<string>, m binary"
PAIR_SCHEMA = "src string, dst string, score double"


def _unit(rows: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, n, out=np.array(rows, dtype="float64"), where=n > 0)


def _matrix(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist(), dtype="float64")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column positions of each row's k best scores; ids are sorted, so a stable sort breaks ties by id."""
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def search(vectors: DataFrame, queries: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """Top-k vectors per query as (query, uuid, score, rnk).

    The query batch is small and checked; vectors are scanned once, each task keeps k rows per query and
    stretch of vectors (SCORES scores at most at a time), and only those are shuffled.
    """
    rows = queries.select(F.col("query").cast("string"), "embedding").limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries; use neighbours() for a full table")
    out_schema = "query string, uuid string, score double"
    if not rows:
        return vectors.sparkSession.createDataFrame([], out_schema + ", rnk int")
    names = np.array([r["query"] for r in rows])
    q = _unit(np.array([r["embedding"] for r in rows], dtype="float64"))
    step = max(1, SCORES // len(rows))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            pdf = pdf.sort_values("uuid")
            for at in range(0, len(pdf), step):
                piece = pdf.iloc[at : at + step]
                ids = piece["uuid"].to_numpy()
                scores = np.round(q @ _unit(_matrix(piece["embedding"])).T, 9)
                best = _best(scores, ids, k)
                top = np.take_along_axis(scores, best, axis=1)
                yield pd.DataFrame(
                    {"query": np.repeat(names, best.shape[1]), "uuid": ids[best].ravel(), "score": top.ravel()}
                )

    hits = vectors.select("uuid", "embedding").mapInPandas(scan, out_schema)
    if min_score is not None:
        hits = hits.where(F.col("score") >= min_score)
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("uuid"))
    return hits.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)


def similarity_matrix(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Clipped cosine of every text vector with every vector of a small item catalogue."""
    rows = items.select(F.col("item").cast("string"), "embedding").orderBy("item").limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"item catalogue exceeds {MAX_QUERIES} rows")
    names = [r["item"] for r in rows]
    q = _unit(np.array([r["embedding"] for r in rows], dtype="float64"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            sims = np.clip(_unit(_matrix(pdf["embedding"])) @ q.T, 0.0, 1.0)
            yield pd.DataFrame({"uuid": pdf["uuid"], "sims": list(sims)})

    return texts.select("uuid", "embedding").mapInPandas(score, "uuid string, sims array<double>").select(
        "uuid", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), "sims")).alias("item", "similarity")
    )


def neighbours(vectors: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest neighbours by cosine of every vector as (src, dst, score, rnk).

    Unit vectors are packed, in the order of their ids, into packs of bounded size, and every pack meets every other: the
    pairs of packs are a nested loop over the packs' partitions, so vectors are neither repeated per visit nor shuffled. A
    task holds one pack and its k best so far, block_rows of them are compared with another pack at a time, and it returns
    k rows per vector; single precision rules pairs out, those left are scored in full precision.
    """
    size = _size(vectors)
    if not size["n"]:
        return vectors.sparkSession.createDataFrame([], PAIR_SCHEMA + ", rnk int")
    packs = _packed(vectors, size, block_rows)
    return _ranked(packs, packs, size, k, block_rows, True)


def nearest_of(queries: DataFrame, vectors: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest of `vectors` by cosine for every one of any number of queries, both (uuid, embedding)."""
    size, inner = _size(queries), _size(vectors)
    if not size["n"] or not inner["n"]:
        return vectors.sparkSession.createDataFrame([], PAIR_SCHEMA + ", rnk int")
    return _ranked(_packed(queries, size, block_rows), _packed(vectors, inner, block_rows), inner, k, block_rows, False)


def _size(vectors: DataFrame) -> Row:
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()


def _bytes(size: Row) -> int:
    return size["n"] * max(1, size["dim"] or 1) * 8


def _packed(vectors: DataFrame, size: Row, block_rows: int) -> DataFrame:
    waves = min(4 * vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(size["n"] / block_rows))
    parts = max(1, waves, math.ceil(_bytes(size) / PACK_BYTES))
    ordered = vectors.select(F.col("uuid").cast("string"), F.col("embedding").cast("array<double>"))
    if parts > 1:
        ordered = ordered.repartitionByRange(parts, "uuid")
    return cut_lineage(ordered.sortWithinPartitions("uuid").mapInArrow(_packs, PACK_SCHEMA))


def _ranked(outer: DataFrame, inner: DataFrame, size: Row, k: int, block_rows: int, same: bool) -> DataFrame:
    sides = [
        side.select(F.struct("part", "seq").alias(f"{s}_pack"), F.col("ids").alias(f"{s}_ids"), F.col("m").alias(f"{s}_m"))
        for s, side in (("l", outer), ("r", inner.coalesce(math.ceil(_bytes(size) / SIDE_BYTES))))
    ]
    met = sides[0].hint("shuffle_replicate_nl").crossJoin(sides[1])
    pairs = met.mapInArrow(lambda batches: _nearest(batches, k, block_rows, same), PAIR_SCHEMA)
    w = Window.partitionBy("src").orderBy(F.desc(F.nanvl("score", F.lit(-2.0))), F.asc("dst"))
    return pairs.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition as packs of at most PACK_BYTES: (part, seq, ids, m), m the unit vectors' doubles."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("ids", pa.list_(pa.string())), ("m", pa.binary())])
    part, seq, ids, rows, held = TaskContext.get().partitionId(), 0, [], [], 0

    def pack():
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.string())), pa.array([np.vstack(rows).tobytes()], pa.binary())],
            schema=schema,
        )

    for batch in batches:
        step = 256
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            v = _unit(_matrix(piece.column("embedding").to_pandas()))
            if held and held + v.nbytes > PACK_BYTES:
                yield pack()
                seq, ids, rows, held = seq + 1, [], [], 0
            ids.extend(piece.column("uuid").to_pylist())
            rows.append(v)
            held += v.nbytes
    if held:
        yield pack()


class _Best:
    """The k best of one pack's vectors so far: score, place in the order of ids, and id per vector."""

    def __init__(self, key: tuple, ids: pa.Array, vectors: np.ndarray, k: int):
        self.key, self.ids, self.v, self.k = key, ids, vectors, k
        self.single = vectors.astype("float32")
        n = len(vectors)
        self.score = np.full((n, k), -np.inf)
        self.place = np.full((n, k), np.iinfo("int64").max)
        self.id = np.full((n, k), None, dtype=object)

    def meet(self, key: tuple, ids: pa.Array, vectors: np.ndarray, block_rows: int, same: bool) -> None:
        single = vectors.astype("float32")
        base = (key[0] << 42) + (key[1] << 24)
        step = max(1, min(block_rows, MAX_ROUGH // max(1, len(vectors))))
        for lo in range(0, len(self.v), step):
            hi = min(len(self.v), lo + step)
            rough = self.single[lo:hi] @ single.T
            own = same and key == self.key
            if own:
                rough[np.arange(hi - lo), np.arange(lo, hi)] = -np.inf
            row, col = np.nonzero(~(rough < self._floor(rough, lo, hi)[:, None]))
            if own:
                other = row + lo != col
                row, col = row[other], col[other]
            for a, b in _runs(row, MAX_SCORED):
                self._take(lo, row[a:b], col[a:b], vectors, base, ids)

    def _floor(self, rough: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """What a rough score must reach: the k-th best so far, or of this pack's first columns."""
        floor = self.score[lo:hi, -1].copy()
        few = rough[:, : max(FIRST_COLUMNS, 4 * self.k)]
        open_rows = np.isneginf(floor)
        if open_rows.any() and few.shape[1] >= self.k:
            floor[open_rows] = np.partition(np.nan_to_num(few[open_rows], nan=-np.inf), -self.k, axis=1)[:, -self.k]
        return floor - SINGLE_ERROR

    def _take(self, lo, row, col, vectors, base, ids) -> None:
        if not len(row):
            return
        score = np.round(np.einsum("ij,ij->i", self.v[row + lo], vectors[col]), 9)
        score[np.isnan(score)] = NO_SCORE
        row, col, score = _first_k(row, col, score, self.k)
        there, start = np.unique(row, return_index=True)
        new = np.concatenate([np.arange(c) for c in np.diff(np.append(start, len(row)))])
        slot = np.searchsorted(there, row)
        n, k = len(there), self.k
        s = np.concatenate([self.score[there + lo], np.full((n, k), -np.inf)], axis=1)
        p = np.concatenate([self.place[there + lo], np.full((n, k), np.iinfo("int64").max)], axis=1)
        i = np.concatenate([self.id[there + lo], np.full((n, k), None, dtype=object)], axis=1)
        s[slot, k + new], p[slot, k + new] = score, base + col
        i[slot, k + new] = np.array(ids.take(pa.array(col)).to_pylist(), dtype=object)
        order = np.lexsort((p, -s), axis=1)[:, :k]
        for held, merged in ((self.score, s), (self.place, p), (self.id, i)):
            held[there + lo] = np.take_along_axis(merged, order, axis=1)

    def rows(self) -> pa.RecordBatch:
        row, col = np.nonzero(~np.isneginf(self.score))
        score = self.score[row, col]
        score[score == NO_SCORE] = np.nan
        return pa.RecordBatch.from_arrays(
            [self.ids.take(pa.array(row)), pa.array(self.id[row, col], pa.string()), pa.array(score, pa.float64())],
            names=["src", "dst", "score"],
        )


def _runs(row: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Slices of sorted row numbers with about `most` entries, so that their vectors are gathered in bounded memory."""
    for a in range(0, len(row), most):
        yield a, min(len(row), a + most)


def _first_k(row: np.ndarray, col: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((col, -score, row))
    row, col, score = row[order], col[order], score[order]
    starts = np.concatenate([[True], row[1:] != row[:-1]])
    rank = np.arange(len(row)) - np.maximum.accumulate(np.where(starts, np.arange(len(row)), 0))
    return row[rank < k], col[rank < k], score[rank < k]


def _nearest(batches: Iterator[pa.RecordBatch], k: int, block_rows: int, same: bool) -> Iterator[pa.RecordBatch]:
    best = None
    for batch in batches:
        for i in range(batch.num_rows):
            sides = []
            for s in "lr":
                ids, raw = batch.column(f"{s}_ids")[i].values, batch.column(f"{s}_m")[i].as_buffer()
                pack = batch.column(f"{s}_pack")[i].as_py()
                sides.append(((pack["part"], pack["seq"]), ids, np.frombuffer(raw, "float64").reshape(len(ids), -1)))
            if best is None or best.key != sides[0][0]:
                if best is not None:
                    yield best.rows()
                best = _Best(*[sides[0][0], pa.concat_arrays([sides[0][1]]), sides[0][2].copy()], k)
            best.meet(*sides[1], block_rows, same)
    if best is not None:
        yield best.rows()
