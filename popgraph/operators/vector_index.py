"""A stored vector index: inverted lists with product codes, searched without collecting queries.

`fit` learns list centres and, for the rest of a vector after its list's centre, one code book per part of the
dimensions, from a bounded sample of rows (SAMPLE_ROWS). `write_index` gives every row its nearest list and its codes, and
writes a table partitioned by list next to a one-row table with the model. `search_index` sends each query to the lists whose
centres are nearest, reads only these partitions, ranks a list's rows by their codes, and scores the best of them exactly.
Lists are cut into blocks and the queries of a list into chunks, so a task's work is bounded whatever their sizes.

With all lists and `rerank=None` every row is scored exactly, so the result equals the exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popgraph.functions.columns import shuffle_key
from popgraph.functions.skew import salted_counts
from popgraph.operators.knn import _best, _matrix, _unit
from popgraph.session import cut_lineage

SAMPLE_ROWS = 20_000
MAX_LISTS = 1024
CODE_WORDS = 256
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
ASKED_ROWS = 1 << 14  # rows of queries and lists that a task holds at a time
HITS = "query string, uuid string, score double"


@dataclass
class Model:
    centres: np.ndarray  # lists x dimensions
    books: list[np.ndarray]  # per part: code words x dimensions of the part

    def parts(self) -> list[slice]:
        ends = np.cumsum([b.shape[1] for b in self.books])
        return [slice(int(e - b.shape[1]), int(e)) for e, b in zip(ends, self.books)]

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of every row."""
        own = _nearest(unit, self.centres)
        rest = unit - self.centres[own]
        return own, np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts(), self.books)], axis=1).astype(np.uint8)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def _centres(x: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """k-means from the first n rows; a centre without rows stays where it is."""
    centres = x[:n].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def fit(vectors: DataFrame, n_lists: int | None = None, n_parts: int = 16, sample_rows: int = SAMPLE_ROWS, rounds: int = 8) -> Model:
    """Model from at most `sample_rows` rows, the first in hash order; by default the square root of all rows as lists."""
    n = vectors.count()
    if not n:
        raise ValueError("no vectors to index")
    lists = min(MAX_LISTS, n_lists or max(1, round(math.sqrt(n))))
    sample = vectors.orderBy(shuffle_key("uuid")).limit(sample_rows).select("embedding").collect()
    x = _unit(np.array([r["embedding"] for r in sample], dtype="float64"))
    centres = _centres(x, min(lists, len(x)), rounds)
    rest = x - centres[_nearest(x, centres)]
    books = [_centres(p, min(CODE_WORDS, len(p)), rounds) for p in np.array_split(rest, min(n_parts, x.shape[1]), axis=1)]
    return Model(centres, books)


def write_index(vectors: DataFrame, path: str, model: Model) -> None:
    """Tables `vectors` (uuid, embedding, codes; partitioned by list) and `model` in the folder `path`."""
    spark = vectors.sparkSession

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not pdf.empty:
                own, codes = model.place(_unit(_matrix(pdf["embedding"])))
                yield pd.DataFrame({"uuid": pdf["uuid"], "embedding": pdf["embedding"], "codes": [c.tobytes() for c in codes], "list": own})

    rows = vectors.select(F.col("uuid").cast("string"), F.col("embedding").cast("array<double>")).mapInPandas(
        place, "uuid string, embedding array<double>, codes binary, list int"
    )
    rows.repartition("list").write.partitionBy("list").parquet(f"{path}/vectors")
    shapes = [list(model.centres.shape)] + [list(b.shape) for b in model.books]
    raw = [bytearray(m.astype("<f8").tobytes()) for m in (model.centres, *model.books)]
    spark.createDataFrame([(shapes, raw)], "shapes array<array<int>>, matrices array<binary>").write.parquet(f"{path}/model")


def read_model(spark: SparkSession, path: str) -> Model:
    row = spark.read.parquet(f"{path}/model").first()
    found = [np.frombuffer(bytes(m), dtype="<f8").reshape(s) for s, m in zip(row["shapes"], row["matrices"])]
    return Model(found[0], found[1:])


def _asked(batches: Iterator[pd.DataFrame], model: Model, probe: int) -> Iterator[pd.DataFrame]:
    """A row per query and one of its `probe` nearest lists, ASKED_ROWS at most at a time."""
    step = max(1, ASKED_ROWS // len(model.centres))
    for pdf in batches:
        for at in range(0, len(pdf), step):
            piece = pdf.iloc[at : at + step]
            q = _unit(_matrix(piece["embedding"]))
            far = (model.centres**2).sum(1)[None, :] - 2 * q @ model.centres.T
            own = np.argsort(far, axis=1, kind="stable")[:, :probe]
            yield pd.DataFrame({"query": np.repeat(piece["query"].to_numpy(), probe), "v": [q[i] for i in np.repeat(np.arange(len(q)), probe)], "list": own.ravel()})


def search_index(
    spark: SparkSession, path: str, queries: DataFrame, k: int, n_probe: int | None = None, rerank: int | None = None,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query, uuid, score, rnk): top k by cosine among the rows of the `n_probe` nearest lists (default: all).

    `rerank` rows per query and block are scored exactly, chosen by their codes (default: all). `queries` = (query, embedding).
    """
    model = read_model(spark, path)
    probe = min(n_probe or len(model.centres), len(model.centres))
    parts = model.parts()

    asked = queries.select(F.col("query").cast("string"), F.col("embedding").cast("array<double>")).mapInPandas(lambda batches: _asked(batches, model, probe), "query string, v array<double>, list int")
    asked = cut_lineage(asked)
    chunks = salted_counts(asked, ["list"], query_rows).withColumnRenamed("n_salts", "chunks")
    wanted = {r["list"]: r["chunks"] for r in chunks.collect()}  # at most MAX_LISTS rows
    if not wanted:
        return spark.createDataFrame([], HITS + ", rnk int")
    rows = spark.read.parquet(f"{path}/vectors").where(F.col("list").isin(list(wanted)))
    sizes = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    dealt = F.broadcast(sizes.join(chunks, "list"))
    block, chunk = F.pmod(F.xxhash64("uuid"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int")
    left = asked.join(dealt, "list").select("query", "v", "list", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = rows.join(dealt, "list").select("uuid", "embedding", "codes", "list", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    def match(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or held.empty:
            return pd.DataFrame({"query": [], "uuid": [], "score": []})
        held = held.sort_values("uuid")
        ids, v, q = held["uuid"].to_numpy(), _unit(_matrix(held["embedding"])), _matrix(asking["v"])
        if rerank is not None and rerank < len(ids):
            codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in held["codes"]])
            rough = np.zeros((len(q), len(ids)))
            for i, (p, book) in enumerate(zip(parts, model.books)):
                rough += (q[:, p] @ book.T)[:, codes[:, i]]
            chosen = np.sort(_best(rough, ids, max(k, rerank)), axis=1)
            scores = np.round(np.einsum("qd,qrd->qr", q, v[chosen]), 9)
            best = _best(scores, ids, k)
            at, top = np.take_along_axis(chosen, best, axis=1), np.take_along_axis(scores, best, axis=1)
        else:
            scores = np.round(q @ v.T, 9)
            at = _best(scores, ids, k)
            top = np.take_along_axis(scores, at, axis=1)
        return pd.DataFrame({"query": np.repeat(asking["query"].to_numpy(), at.shape[1]), "uuid": ids[at].ravel(), "score": top.ravel()})

    key = ["list", "block", "chunk"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(match, HITS)
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("uuid"))
    return hits.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the share of the exact hits that the search found."""
    met = exact.select("query", "uuid").join(found.select("query", "uuid", F.lit(1).alias("hit")), ["query", "uuid"], "left")
    return met.agg(F.count_distinct("query").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
