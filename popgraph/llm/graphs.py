"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.llm.common import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node each node of (a, b) edges is connected with. Nulls and loops are ignored.

    Large-star and small-star steps in turn: every step hangs nodes on the smallest node they know, until
    nothing changes; no round limit. Each round is written to the shared folder.
    """

    def star(links: DataFrame, small: bool) -> DataFrame:
        """`small`: each node's smaller neighbours and itself go to the smallest; else its larger neighbours."""
        both = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        met = both.join(low, "a")
        if small:
            moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        else:
            moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.where(F.col("a") != F.col("b"))

    def state(links: DataFrame):
        return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    high, low = F.greatest("a", "b"), F.least("a", "b")
    links = kept(edges.where(F.col("a") != F.col("b")).select(high.alias("a"), low.alias("b")).distinct(), "links")
    before = None
    while (now := state(links)) != before:
        before = now
        links = kept(star(star(links, False), True).distinct(), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    )
