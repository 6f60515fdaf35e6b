"""Joins and rankings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgraph.session import cut_lineage

HOT_ROWS = 100_000


def salted_counts(df: DataFrame, keys: list[str], rows_per_salt: int = HOT_ROWS) -> DataFrame:
    """Number of salts each key needs so that no (key, salt) group exceeds rows_per_salt rows."""
    return df.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(rows_per_salt)).cast("int").alias("n_salts")
    )


def spread(edges: DataFrame, key: str, other: str, salts: DataFrame) -> DataFrame:
    """Attach a salt to each edge; a key with one salt keeps salt 0. `salts` = (key, n_salts).

    Only keys with more than one salt are looked up. There are at most as many as rows divided by the rows a salt
    stands for, so they are broadcast: a hot key's rows never meet before they are salted.
    """
    hot = salts.where(F.col("n_salts") > 1).select(F.col(key).alias("__hot"), "n_salts")
    met = edges.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    n = F.coalesce("n_salts", F.lit(1))
    return met.withColumn("salt", F.pmod(F.xxhash64(F.col(other)), n).cast("int")).drop("n_salts", "__hot")


def replicate(nodes: DataFrame, salts_col: str = "n_salts") -> DataFrame:
    """Repeat each node once per salt it needs, to meet the edges `spread` produced."""
    return nodes.withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col(salts_col) - 1))
    ).drop(salts_col)


def hashed_row_number(
    df: DataFrame, keys: list[str], order_hash: Column, out: str, total: str | None = None
) -> DataFrame:
    """row_number() over keys in the order of a hex hash, without one task per key.

    The first two hex digits cut each key into 256 even buckets; the position is the number of
    rows in the key's earlier buckets plus the position inside the bucket. `total` adds the key's
    row count.
    """
    rows = df.withColumn("__h", order_hash).withColumn("__b", F.substring("__h", 1, 2))
    sizes = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("__n").over(Window.partitionBy(*keys)))
    offsets = offsets.drop("__n")
    inside = Window.partitionBy(*keys, "__b").orderBy("__h")
    return (
        rows.withColumn("__i", F.row_number().over(inside))
        .join(offsets, [*keys, "__b"])
        .withColumn(out, (F.col("__i") + F.col("__before")).cast("int"))
        .drop("__h", "__b", "__i", "__before")
    )


def running_count(df: DataFrame, keys: list[str], at: str, value: str, block: int, out: str) -> DataFrame:
    """Sum of `value` over a key's rows with a position up to this row's, equal positions included.

    Positions are cut into blocks: totals of earlier blocks plus a running sum inside the block, so a
    key with very many rows is spread over its blocks.
    """
    rows = df.withColumn("__b", F.floor(F.col(at) / block))
    totals = rows.groupBy(*keys, "__b").agg(F.sum(value).alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__base", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    inside = Window.partitionBy(*keys, "__b").orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("__in", F.sum(value).over(inside))
        .join(totals, [*keys, "__b"])
        .withColumn(out, F.col("__in") + F.col("__base"))
        .drop("__b", "__in", "__base")
    )


def dense_index(df: DataFrame, order_cols: list[str], out: str) -> DataFrame:
    """0-based position of every row in the global order of order_cols, computed range by range.

    Rows are range-partitioned and sorted; a row's position is the number of rows in earlier ranges
    (a table with one row per partition) plus its place in its own range. The ranged rows are
    checkpointed so that both uses see the same ranges.
    """
    ranged = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    ranged = cut_lineage(
        ranged.withColumn("__id", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__id", 33))
        .withColumn("__pos", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__id")
    )
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return (
        ranged.join(offsets, "__part")
        .withColumn(out, F.col("__pos") + F.col("__start"))
        .drop("__part", "__pos", "__start")
    )


def by_key(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Hash-partition rows that a following join multiplies.

    The explicit partition number keeps adaptive execution from packing them, small as they still
    are, into a few tasks. `least` asks for more partitions where the multiplied rows need them.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), least)
    return df.repartition(n, *keys)


MAX_BROADCAST_BYTES = 256 << 20


def measured_bytes(df: DataFrame) -> int:
    """Size of a table's rows as text, an estimate of what a broadcast of it takes."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def join_measured(big: DataFrame, small: DataFrame, key: str, spread_by: str, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Inner join with a table that is usually small: broadcast when its measured size allows it.

    Broadcasting leaves `big` partitioned as it was, so a following aggregation by that partitioning
    needs no shuffle. A larger table is joined on (key, salt) instead, hot keys spread over salts.
    """
    if measured_bytes(small) <= max_bytes:
        return big.join(F.broadcast(small), key)
    salts = salted_counts(big, [key])
    left = spread(big, key, spread_by, salts)
    return left.join(replicate(small.join(salts, key)), [key, "salt"]).drop("salt")
