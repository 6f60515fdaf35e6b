"""Hard-negative mining by a BOND scan: vectors stand column by column, and an anchor reads the columns in the
descending order of its own components' magnitude.

After some columns every row has a partial inner product, and the columns still to come can add no less than the
sum of their smallest contributions and no more than the sum of their largest, both from the minimum and maximum
of each column in the block. Rows that these bounds rule out leave the candidate bitmap; the others go on until all
columns are read, when their scores are exact. Two scans: `nearest` finds the positives of every anchor, `in_windows`
the negatives whose scores lie in the windows that the positives' scores set.

Rows are dealt by hash into blocks of about BLOCK_ROWS, anchors into groups of at most GROUP_ANCHORS; a task takes one
group and one block, so its memory is bounded, and returns at most k rows per anchor or window. The results of
all blocks meet per anchor, and Spark cuts them to k before and after the shuffle. Anchors against rows is the work asked
for: a stated query set against all rows, in blocks.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; scaled components
are cut at +-2**24, so that every score is exact; a vector shorter than the longest counts as filled up with zeros; a
null id is no anchor and goes last among ties; rows with equal ids are rows of their own, ordered by their place in the
table; an anchor without positives or negatives gives no rows; an empty table gives an empty result; other columns of
the table are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgraph.llm.common import kept, numbered, prepare

SCALE = 256
LIMIT = 1 << 24
BLOCK_ROWS = 2048
GROUP_ANCHORS = 8192
STEP = 8  # columns between two looks at the bounds
WINDOW = (30, 90)  # percent of the positive's score
NULL_ID = (1 << 63) - 1

NEAR = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("score", pa.int64()), ("row", pa.int64()), ("id", pa.int64())])
FOUND = pa.schema([("anchor", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])


class Block:
    """Rows of one block: columns, their smallest and largest values, and ids, places and labels of the rows."""

    def __init__(self, rows: pa.Table, width: int):
        self.ids, self.rows, self.labels = (rows.column(c).to_numpy() for c in ("id", "row", "label"))
        self.columns = matrix(rows.column("vector"), width).T.copy()
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)

    def take(self, chosen: np.ndarray) -> Block:
        out = object.__new__(Block)
        out.ids, out.rows, out.labels = self.ids[chosen], self.rows[chosen], self.labels[chosen]
        out.columns = np.ascontiguousarray(self.columns[:, chosen])
        out.low, out.high = out.columns.min(axis=1), out.columns.max(axis=1)
        return out


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of lists as a matrix, filled up with zeros. Products are summed in doubles while these are exact."""
    vectors = vectors.combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks)
    sizes = vectors.value_lengths().to_numpy()
    flat = vectors.flatten().to_numpy()
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    peak = int(np.abs(flat).max()) if len(flat) else 0
    return out.astype(np.float64) if peak * LIMIT * width < 1 << 53 else out


def scan(anchor: np.ndarray, block: Block, alive: np.ndarray, drop) -> tuple[np.ndarray, np.ndarray]:
    """(places in the block, exact scores) of the rows that `drop(lowest, highest)` never rules out.

    `alive` holds the places to start from. `drop` gets the bounds of every row still there and returns the rows to leave out.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    a = anchor[order].astype(block.columns.dtype)
    ends = np.stack([a * block.low[order], a * block.high[order]])
    # least and most that the columns from place i on add
    least = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
    most = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
    score = np.zeros(len(alive), dtype=a.dtype)
    for at in range(0, len(a), STEP):
        columns = order[at : at + STEP]
        part = block.columns[columns] if len(alive) == block.columns.shape[1] else block.columns[np.ix_(columns, alive)]
        score = score + a[at : at + STEP] @ part
        done = min(at + STEP, len(a))
        gone = drop(score + least[done], score + most[done])
        if gone.any():
            alive, score = alive[~gone], score[~gone]
            if not len(alive):
                break
    return alive, score.astype(np.int64)


def best(k: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the first k by falling score, id, row."""
    return np.lexsort((rows, ids, -score))[:k]


def nearest_in_block(anchors: pa.Table, block: Block, k: int, width: int) -> list[tuple]:
    """The first k other rows of an anchor's label in this block."""
    out, of_label = [], {int(x): block.take(np.flatnonzero(block.labels == x)) for x in np.unique(block.labels)}
    vectors = matrix(anchors.column("vector"), width)
    for i, (row, id_, label) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("row", "id", "label")))):
        own = of_label.get(label)
        if own is None:
            continue

        def drop(low, high):
            if len(low) <= k:
                return np.zeros(len(low), dtype=bool)
            return high < np.partition(low, len(low) - k)[len(low) - k]

        alive, score = scan(vectors[i], own, np.flatnonzero(own.rows != row), drop)
        for j in best(k, score, own.ids[alive], own.rows[alive]):
            out.append((row, id_, int(score[j]), int(own.rows[alive[j]]), int(own.ids[alive[j]])))
    return out


def windows_in_block(anchors: pa.Table, block: Block, k: int, width: int) -> list[tuple]:
    """The first k rows of other labels in every window of an anchor in this block."""
    out, vectors = [], matrix(anchors.column("vector"), width)
    others = {int(x): np.flatnonzero(block.labels != x) for x in np.unique(block.labels)}
    whole = np.arange(len(block.rows))
    for i, (row, label, windows) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("row", "label", "windows")))):
        spans = [(w["low"], w["high"]) for w in windows]

        def drop(low, high):
            gone = np.ones(len(low), dtype=bool)
            for a, b in spans:
                out_of = (high < a) | (low > b)
                sure = (low >= a) & (high <= b)
                if sure.sum() >= k:  # k rows are in the window for certain: what can't reach them goes
                    least = low[sure]
                    out_of |= high < np.partition(least, len(least) - k)[len(least) - k]
                gone &= out_of
            return gone

        alive, score = scan(vectors[i], block, others.get(label, whole), drop)
        for a, b in spans:
            inside = np.flatnonzero((score >= a) & (score <= b))
            places = alive[inside]
            for j in best(k, score[inside], block.ids[places], block.rows[places]):
                out.append((row, a, b, int(score[inside[j]]), int(block.ids[places[j]]), int(block.rows[places[j]])))
    return out


def by_blocks(anchors: DataFrame, rows: DataFrame, n_blocks: int, n_groups: int, schema: pa.Schema, search) -> DataFrame:
    """`search(anchors, block)` for every group of anchors and block of rows, in tasks of their own."""
    spread = anchors.withColumns({
        "__group": F.pmod(F.xxhash64("row"), F.lit(n_groups)), "__block": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))),
    })
    dealt = rows.select(*(F.col(c).alias(c) for c in rows.columns)).withColumns({
        "__group": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_groups - 1).cast("bigint"))), "__block": F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"),
    })

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            width = max(int(np.max(t.column("vector").combine_chunks().value_lengths().to_numpy())) for t in (left, right))
            found = search(left, Block(right, width), width) if width else []
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * len(schema), schema.types)], schema=schema)

    keys = ["__group", "__block"]
    out = ", ".join(f"{f.name} bigint" for f in schema)
    return spread.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(run, out)


def first(df: DataFrame, k: int, keys: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of every key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def vectors_of(table: DataFrame, id: str, vector: str, label: Column | str, is_anchor: Column) -> DataFrame:
    """(row, id, label, vector, is_anchor) of the rows that take part; vectors as whole numbers."""
    label = F.col(label) if isinstance(label, str) else label
    scaled = F.transform(F.col(vector), lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("bigint"))
    finite = ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return numbered(table).where(label.isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col("__row").alias("row"), F.coalesce(F.col(id).cast("bigint"), F.lit(NULL_ID)).alias("id"), label.cast("bigint").alias("label"),
        scaled.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )


def mine(
    table: DataFrame, id: str, vector: str, label: Column | str, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10,
    window: tuple[int, int] = WINDOW, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor, anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    `label` and `is_anchor` are expressions over `table`, a table of Parquet files; `anchor` is the anchor's row number.
    """
    prepare(table.sparkSession)
    rows = kept(vectors_of(table, id, vector, label, is_anchor), "vectors")
    counts = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    n_blocks, n_groups = (max(1, -(-n // size)) for n, size in zip(counts, (block_rows, GROUP_ANCHORS)))
    own = rows.select("row", "id", "label", "vector")
    anchors = rows.where("is_anchor").select("row", "id", "label", "vector")

    near = by_blocks(anchors, own, n_blocks, n_groups, NEAR, lambda a, b, width: nearest_in_block(a, b, n_positives, width))
    order = [F.col("score").desc(), F.col("id"), F.col("row")]
    positives = kept(first(near, n_positives, ["anchor"], order).drop("rank"), "positives")

    # the whole scores s with low * p <= 100 * s <= high * p
    low, high = (f"{w} * score" for w in window)
    bounds = F.expr(f"struct(({low} + 99 - pmod({low} + 99, 100)) div 100 AS low, ({high} - pmod({high}, 100)) div 100 AS high)")
    positives = positives.withColumn("bounds", bounds)
    windows = positives.where("bounds.low <= bounds.high").groupBy("anchor").agg(F.collect_set("bounds").alias("windows"))
    asking = anchors.join(windows, F.col("row") == F.col("anchor")).select("row", "label", "vector", "windows")
    found = by_blocks(asking, own, n_blocks, n_groups, FOUND, lambda a, b, width: windows_in_block(a, b, n_negatives, width))
    negatives = first(found, n_negatives, ["anchor", "low", "high"], order).select(
        F.col("anchor").alias("of"), F.struct("low", "high").alias("span"), F.col("score").alias("negative_score"), F.col("id").alias("negative"), "rank"
    )
    return positives.join(negatives, (F.col("anchor") == F.col("of")) & (F.col("bounds") == F.col("span"))).select(
        "anchor", "anchor_id", F.nullif("id", F.lit(NULL_ID)).alias("positive_id"), "rank", F.nullif("negative", F.lit(NULL_ID)).alias("negative_id"),
        F.col("score").alias("positive_score"), "negative_score",
    )
