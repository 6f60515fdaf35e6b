"""Communities by modularity: local moves, refinement into connected parts, contraction, level by level.

A level's graph is adj(src, dst, w), every edge in both directions, whole weights; a contracted node keeps the weight inside
it as a loop. In a round every node weighs its own and its neighbours' communities: the gain of standing in community
c is M * w(v, c) - k(v) * S(c), with M the sum of all degrees, k the node's degree and S the degrees of c without the
node itself. Half of the nodes, another half every round (a hash of node and round), move to the best one if it is strictly
better; ties go to the smaller name. Gains are whole numbers, so a run repeats exactly. A level ends when no node would
move, or after `max_rounds`; then every community is split into its connected parts, which never lowers modularity,
and each part becomes a node of the next level, named after its smallest member. Levels end when nothing moves any more,
when modularity rises by no more than `tolerance`, or after `max_levels`.

Nodes are numbered in the order of their names, so smaller names are smaller numbers; names come back at the end.
Every step is a shuffle by (node, community) or by node over rows no more than edges; communities and their degrees are
broadcast below a measured size, otherwise hub nodes send over salts and degrees are joined over salts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.functions.columns import row_count
from popgraph.functions.skew import HOT_ROWS, dense_index, join_measured, replicate, spread
from popgraph.operators.algorithms import components
from popgraph.sources.files import stored

WHOLE = "decimal(18,0)"  # products of two stay within 38 digits
LONG_TOTAL = 3_000_000_000  # up to this sum of degrees a gain, at most its square, is a bigint
MAX_BROADCAST_NODES = 2_000_000  # rows of two numbers


class WeightedGraph:
    """Edges without loops, spread over salts, with the degree k of their end, and (node, name, k, n_salts): degrees with loops."""

    def __init__(self, adj: DataFrame, names: DataFrame, rows_per_salt: int = HOT_ROWS):
        between = F.col("src") != F.col("dst")
        nodes = adj.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"), F.count_if(between).alias("n"))
        salts = F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_salt)).cast("int").alias("n_salts")
        self.nodes = stored(nodes.select("node", "k", salts).join(names.select("node", "name"), "node"))
        self.few = self.nodes.count() <= MAX_BROADCAST_NODES
        ends = self.nodes.select(F.col("node").alias("dst"), "k")
        links = adj.where(between).select("src", "dst", "w").join(F.broadcast(ends) if self.few else ends, "dst")
        self.edges = stored(spread(links, "src", "dst", self.nodes.select(F.col("node").alias("src"), "n_salts")))
        self.total = adj.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]

    def heard(self, labels: DataFrame) -> DataFrame:
        """(node, label, k, w, own): the weight between a node and each neighbouring community; its own one with weight 0 added."""
        said = labels.select(F.col("node").alias("src"), "label", "n_salts")
        if self.few:
            sent = self.edges.join(F.broadcast(said.drop("n_salts")), "src")
        else:
            sent = replicate(said).join(self.edges, ["src", "salt"])
        own = labels.select("node", "label", "k", F.lit(0).cast("bigint").alias("w"), F.lit(True).alias("own"))
        rows = sent.select(F.col("dst").alias("node"), "label", "k", "w", F.lit(False).alias("own")).unionByName(own)
        return rows.groupBy("node", "label", "k").agg(F.sum("w").alias("w"), F.max("own").alias("own"))


def _moves(g: WeightedGraph, labels: DataFrame, round_no: int) -> DataFrame:
    """(node, name, k, n_salts, label before, wish, label now): the best community of every node, taken by this round's half."""
    degrees = labels.groupBy("label").agg(F.sum("k").alias("s"))
    whole = "bigint" if g.total <= LONG_TOTAL else WHOLE
    met = join_measured(g.heard(labels), degrees, "label", "node")
    others = (F.col("s") - F.when(F.col("own"), F.col("k")).otherwise(F.lit(0))).cast(whole)
    gain = F.lit(g.total).cast(whole) * F.col("w").cast(whole) - F.col("k").cast(whole) * others
    best = met.select("node", "label", gain.alias("gain"), "own").groupBy("node").agg(
        F.min(F.struct((-F.col("gain")).alias("less"), (~F.col("own")).alias("moves"), "label")).alias("b")
    )
    half = F.substring(F.md5(F.concat_ws(":", "name", F.lit(str(round_no)))), 1, 1).isin(list("02468ace"))
    return labels.join(best, "node").select(
        "node", "name", "k", "n_salts", F.col("label").alias("before"), F.col("b.label").alias("wish"),
        F.when(half, F.col("b.label")).otherwise(F.col("label")).alias("label"),
    )


def one_level(adj: DataFrame, ids: DataFrame, max_rounds: int = 12, rows_per_salt: int = HOT_ROWS) -> tuple[DataFrame, bool]:
    """((node, part) of one level: local moves, then connected parts of each community; did any node move? ids(node, name)."""
    g = WeightedGraph(adj, ids, rows_per_salt)
    labels = g.nodes.withColumn("label", F.col("node"))
    moved = False
    for i in range(max_rounds):
        now = stored(_moves(g, labels, i))
        wishes = now.agg(F.count_if(F.col("wish") != F.col("before")), F.count_if(F.col("label") != F.col("before"))).first()
        labels, moved = now.drop("before", "wish"), moved or wishes[1] > 0
        if not wishes[0]:
            break
    if not moved:
        return g.nodes.select("node", F.col("node").alias("part")), False
    names = labels.select("node", "label")
    inside = (
        adj.where(F.col("src") != F.col("dst")).select("src", "dst")
        .join(names.toDF("src", "la"), "src").join(names.toDF("dst", "lb"), "dst")
        .where(F.col("la") == F.col("lb")).select("src", "dst")
    )
    return components(names.select("node"), stored(inside)).select("node", F.col("comp").alias("part")), True


def contract(adj: DataFrame, parts: DataFrame) -> DataFrame:
    """The graph of the parts: weights between them, weights inside as loops."""
    met = adj.join(parts.toDF("src", "a"), "src").join(parts.toDF("dst", "b"), "dst")
    return met.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))


def quality(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """(communities, modularity) of (node, label); adj(src, dst, w) holds both directions."""
    met = adj.join(labels.toDF("src", "la"), "src").join(labels.toDF("dst", "lb"), "dst")
    per = met.groupBy(F.col("la").alias("label")).agg(F.sum("w").alias("deg"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(F.lit(0))).alias("inside"))
    deg = F.col("deg").cast("double")
    sums = per.agg(row_count("communities"), F.sum(deg).alias("d"), F.sum("inside").alias("i"), F.sum(deg * deg).alias("s"))
    return sums.select("communities", F.when(F.col("d") > 0, F.col("i") / F.col("d") - F.col("s") / (F.col("d") * F.col("d"))).otherwise(F.lit(0.0)).alias("modularity"))


def louvain(
    adj: DataFrame, tolerance: float = 1e-4, max_rounds: int = 12, max_levels: int = 10, rows_per_salt: int = HOT_ROWS
) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """((node, community_id), [(level, communities, modularity)]) of adj(src, dst[, w]).

    Without `w` every edge weighs 1. A community is named after its smallest node. An empty graph has no communities.
    """
    graph = adj if "w" in adj.columns else adj.select("src", "dst", F.lit(1).cast("bigint").alias("w"))
    graph = stored(graph.groupBy("src", "dst").agg(F.sum("w").cast("bigint").alias("w")))
    start = stored(graph.select(F.col("src").alias("name")).distinct())
    ids = stored(dense_index(start.where(F.col("name").isNotNull()), ["name"], "node").select("node", "name"))
    level_graph = stored(
        graph.join(ids.toDF("a", "src"), "src", "left").join(ids.toDF("b", "dst"), "dst", "left")
        .select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    )
    names = ids.select(F.col("name").alias("node"), F.col("node").alias("community_id"))
    first = quality(level_graph, ids.select("node", F.col("node").alias("label"))).first()
    levels, score = [], first["modularity"]
    for level in range(1, max_levels + 1):
        parts, moved = one_level(level_graph, ids, max_rounds, rows_per_salt)
        if not moved:
            break
        parts = stored(parts)
        above = parts.toDF("community_id", "part")
        after = stored(names.join(above, "community_id").select("node", F.col("part").alias("community_id")))
        level_graph = stored(contract(level_graph, parts))
        # of the contracted graph, so the labels are its nodes
        now = quality(level_graph, parts.select(F.col("part").alias("node"), F.col("part").alias("label")).distinct()).first()
        if now["modularity"] <= score:
            break
        names, gain, score = after, now["modularity"] - score, now["modularity"]
        levels.append((level, now["communities"], score))
        if gain <= tolerance:
            break
    if not levels:
        return start.select(F.col("name").alias("node"), F.col("name").alias("community_id")), levels
    return names.join(ids.toDF("community_id", "community"), "community_id").select("node", F.col("community").alias("community_id")), levels
