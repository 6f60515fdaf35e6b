"""Iterative graph algorithms as DataFrame rounds over adj(src, dst), every edge in both directions.

High-degree nodes (a country, a popular hobby) are salted once: their edges are spread over several
(src, salt) keys and only the node's own value is repeated per salt, so no round has a hub task.
Rounds end in a reliable checkpoint, which keeps plans short and survives the loss of an executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.functions.columns import row_count, shuffle_key, top_n_global
from popgraph.functions.skew import HOT_ROWS, by_key, replicate, salted_counts, spread
from popgraph.functions.vectors import vector_sums
from popgraph.operators.blocks import BlockGraph
from popgraph.session import cut_lineage


class Graph:
    """Adjacency prepared for repeated joins: spread edges and the salts and degree of each node."""

    def __init__(self, adj: DataFrame, rows_per_salt: int = HOT_ROWS):
        self.salts = cut_lineage(
            adj.groupBy("src").agg(
                row_count("degree"),
                F.ceil(F.count(F.lit(1)) / F.lit(rows_per_salt)).cast("int").alias("n_salts"),
            )
        )
        self.edges = cut_lineage(spread(adj.select("src", "dst"), "src", "dst", self.salts.select("src", "n_salts")))

    def send(self, values: DataFrame) -> DataFrame:
        """Deliver each node's columns along its edges: values(node, ...) -> rows (dst, src, ...)."""
        out = values.withColumnRenamed("node", "src").join(self.salts.select("src", "n_salts"), "src")
        return replicate(out).join(self.edges, ["src", "salt"]).drop("salt")

    @property
    def nodes(self) -> DataFrame:
        return self.salts.select(F.col("src").alias("node"), "degree")


def degree(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("src").alias("node")).agg(row_count("degree"))


def pagerank(
    adj: DataFrame, iterations: int = 20, damping: float = 0.85, keep_every: int = 5, rows_per_salt: int = HOT_ROWS
) -> DataFrame:
    """Un-normalised PageRank: (1-d) + d * sum of rank/degree over neighbours."""
    g = Graph(adj, rows_per_salt)
    ranks = g.nodes.select("node", "degree", F.lit(1 - damping).alias("rank"))
    for i in range(iterations):
        share = g.send(ranks.select("node", (F.col("rank") / F.col("degree")).alias("share")))
        sums = share.groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("s"))
        ranks = g.nodes.join(sums, "node", "left").select(
            "node", "degree", (F.lit(1 - damping) + damping * F.coalesce("s", F.lit(0.0))).alias("rank")
        )
        if (i + 1) % keep_every == 0:
            ranks = cut_lineage(ranks)
    return ranks.select("node", "rank")


def components(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """Smallest reachable node id per node: neighbour minimum, then a jump to the label's own label.

    The jump halves the distance still to go, so long chains settle in logarithmic rounds. Labels
    that many nodes share are looked up through salted keys.
    """
    g = Graph(adj)
    labels = nodes.select("node", F.col("node").alias("comp"))
    while True:
        heard = g.send(labels).groupBy(F.col("dst").alias("node")).agg(F.min("comp").alias("heard"))
        lower = labels.join(heard, "node", "left").select(
            "node", F.col("comp").alias("old"), F.least("comp", F.coalesce("heard", "comp")).alias("comp")
        )
        lower = cut_lineage(lower)
        jump = lower.select(F.col("node").alias("comp"), F.col("comp").alias("target"))
        salts = salted_counts(lower, ["comp"])
        mine = spread(lower, "comp", "node", salts)
        jumped = mine.join(replicate(jump.join(salts, "comp")), ["comp", "salt"]).select(
            "node", "old", F.least("comp", "target").alias("comp")
        )
        labels = cut_lineage(jumped)
        settled = labels.where(F.col("old") != F.col("comp")).isEmpty()
        labels = labels.select("node", "comp")
        if settled:
            return labels


def largest_component_ratio(nodes: DataFrame, adj: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Share of the remaining nodes that the largest component holds."""
    kept, links = nodes.select("node"), adj.select("src", "dst")
    if excluded is not None:
        gone = excluded.select("node")
        kept = kept.join(gone, "node", "left_anti")
        links = links.join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
        links = links.join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    sizes = components(kept, links).groupBy("comp").agg(row_count("size"))
    return sizes.agg(
        F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.coalesce(F.sum("size"), F.lit(0)).alias("remaining")
    ).select(
        "largest", "remaining",
        F.when(F.col("remaining") > 0, F.round(F.col("largest") / F.col("remaining"), 4)).otherwise(F.lit(0.0)).alias("ratio"),
    )


def k_hop(adj: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Nodes within `depth` hops of the seeds with their distance."""
    if not 0 <= depth <= 3:
        raise ValueError("depth must be between 0 and 3")
    g = Graph(adj)
    reached = seeds.select("node", F.lit(0).alias("hops")).distinct()
    frontier = reached
    for d in range(1, depth + 1):
        step = g.send(frontier.select("node"))
        frontier = cut_lineage(
            step.select(F.col("dst").alias("node")).distinct().join(reached.select("node"), "node", "left_anti")
            .withColumn("hops", F.lit(d))
        )
        reached = reached.unionByName(frontier)
    return reached


def induced(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    inside = nodes.select("node")
    return adj.select("src", "dst").join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(
        inside.withColumnRenamed("node", "dst"), "dst", "left_semi"
    ).distinct()


def removal_impact(adj: DataFrame, targets: list[str], depth: int, communities: DataFrame | None = None) -> DataFrame:
    """Connectivity of the targets' neighbourhood before and after they are removed."""
    if not 1 <= len(targets) <= 5 or len(set(targets)) != len(targets):
        raise ValueError("one to five distinct targets are required")
    if not 1 <= depth <= 3:
        raise ValueError("depth must be between 1 and 3")
    spark = adj.sparkSession
    wanted = spark.createDataFrame([(t,) for t in targets], "node string")
    seeds = adj.select(F.col("src").alias("node")).join(F.broadcast(wanted), "node", "left_semi").distinct()
    if seeds.isEmpty():
        return spark.createDataFrame(
            [(False, 0.0, 0.0, 0.0, "")],
            "path_found boolean, original double, current double, fragmentation double, affected_communities string",
        )
    nodes = cut_lineage(k_hop(adj, seeds, depth))
    links = cut_lineage(induced(adj, nodes))
    before = largest_component_ratio(nodes, links).first()["ratio"]
    after = largest_component_ratio(nodes, links, wanted).first()["ratio"]
    hit = communities.where(F.col("node").isin(targets)).select("community_id").distinct() if communities is not None else None
    affected = ",".join(sorted(str(r[0]) for r in hit.collect())) if hit is not None else ""
    return spark.createDataFrame(
        [(True, before, after, round(max(before - after, 0.0), 4), affected)],
        "path_found boolean, original double, current double, fragmentation double, affected_communities string",
    )


def betweenness(adj: DataFrame, sampling_size: int, seed: int = 42) -> DataFrame:
    """Shortest-path dependencies summed over sampled sources, halved because edges go both ways.

    All sources advance together: one table of (source, node, depth, paths) per level, then the
    dependencies flow back level by level.
    """
    g = Graph(adj)
    picked = top_n_global(g.nodes.select("node"), [F.asc(shuffle_key("node", seed=seed)), F.asc("node")], sampling_size)
    level = cut_lineage(picked.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("s", "node")
    while True:
        sent = g.send(levels[-1]).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = cut_lineage(sent.join(seen, ["s", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "node"))
    total = None
    below = levels[-1].withColumn("delta", F.lit(0.0))
    for level in reversed(levels[:-1]):
        ready = below.select("s", "node", ((1 + F.col("delta")) / F.col("paths")).alias("part"))
        back = g.send(ready).groupBy("s", F.col("dst").alias("node")).agg(F.sum("part").alias("part"))
        current = cut_lineage(
            level.join(back, ["s", "node"], "left").withColumn("delta", F.col("paths") * F.coalesce("part", F.lit(0.0))).drop("part")
        )
        inner = current.where(F.col("s") != F.col("node")).select("node", "delta")
        total = inner if total is None else total.unionByName(inner)
        below = current
    if total is None:
        return g.nodes.select("node", F.lit(0.0).alias("betweenness"))
    sums = total.groupBy("node").agg((F.sum("delta") / 2).alias("betweenness"))
    return g.nodes.select("node").join(sums, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def random_sign_vector(node, dim: int, scale: float, first: int = 0):
    """Sparse start vector from a hash of node and position, `dim` of them from `first` on: + and - with probability 1/6 each."""
    def element(i):
        h = F.substring(F.md5(F.concat_ws(":", node, i.cast("string"))), 1, 4)
        return F.when(h < "2aaa", F.lit(scale)).when(h >= "d555", F.lit(-scale)).otherwise(F.lit(0.0))

    return F.transform(F.sequence(F.lit(first), F.lit(first + dim - 1)), element)


def fastrp(adj: DataFrame, dim: int = 256, weights: tuple[float, ...] = (0.0, 1.0, 1.0, 1.0)) -> DataFrame:
    """Random projection smoothed over neighbours, unit length per round, weighted sum of the rounds."""
    g = BlockGraph(adj, dim)
    spread_nodes = by_key(g.nodes.select("node"), "node")
    state, kept = g.packed_slices(lambda lo, n: spread_nodes.select("node", random_sign_vector(F.col("node"), n, 3.0**0.5, lo).alias("v"))), []
    for w in weights:
        state = g.sums(state)
        if w:
            kept.append((w, state))
    if not kept:
        return g.nodes.select("node", F.array_repeat(F.lit(0.0), dim).alias("embedding"))
    return g.unpacked(kept)


def normalized_adjacency(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Bipartite weights 1/sqrt(degree * degree) of each pair."""
    dl = pairs.groupBy(left).agg(F.greatest(row_count("d"), F.lit(1)).alias("dl"))
    dr = pairs.groupBy(right).agg(F.greatest(row_count("d"), F.lit(1)).alias("dr"))
    return pairs.join(dl, left).join(dr, right).select(left, right, (1 / F.sqrt(F.col("dl") * F.col("dr"))).alias("weight"))


def propagate(adj: DataFrame, start: DataFrame, dim: int, layers: int) -> DataFrame:
    """Mean of the start vectors and `layers` rounds of degree-normalised neighbour sums."""
    g = Graph(adj)
    deg = g.nodes
    current = deg.join(start, "node").select("node", "degree", "v")
    total = current.select("node", F.col("v").alias("embedding"))
    for _ in range(layers):
        scaled = current.select("node", F.transform("v", lambda x: x / F.sqrt("degree")).alias("v"))
        sums = vector_sums(g.send(scaled), ["dst"], "v", dim).withColumnRenamed("dst", "node")
        current = cut_lineage(deg.join(sums, "node").select("node", "degree", F.transform("v", lambda x: x / F.sqrt("degree")).alias("v")))
        total = total.join(current.select("node", "v"), "node").select(
            "node", F.zip_with("embedding", "v", lambda a, b: a + b).alias("embedding")
        )
    return total.select("node", F.transform("embedding", lambda x: x / (layers + 1)).alias("embedding"))


def label_propagation(adj: DataFrame, rounds: int = 10) -> DataFrame:
    """Each node takes its neighbours' most frequent label; odd and even nodes move in turn.

    `rounds` is part of the definition: nodes of one parity move together, so labels may swap for ever.
    """
    g = Graph(adj)
    labels = g.nodes.select("node", F.col("node").alias("label"))
    for i in range(rounds):
        counts = g.send(labels).groupBy(F.col("dst").alias("node"), "label").agg(row_count())
        best = counts.groupBy("node").agg(F.min(F.struct((-F.col("cnt")).alias("neg"), "label")).alias("b"))
        even = F.substring(F.md5("node"), 1, 1).isin(list("02468ace"))
        moves = even if i % 2 == 0 else ~even
        labels = cut_lineage(
            labels.join(best, "node", "left").select(
                "node", F.when(moves, F.coalesce("b.label", "label")).otherwise(F.col("label")).alias("label")
            )
        )
    return labels


def communities(adj: DataFrame, rounds: int = 10) -> DataFrame:
    """Label propagation, then every label is split into its connected parts."""
    labels = label_propagation(adj, rounds)
    a, b = labels.toDF("src", "la"), labels.toDF("dst", "lb")
    same = adj.select("src", "dst").join(a, "src").join(b, "dst").where(F.col("la") == F.col("lb")).select("src", "dst")
    return components(labels.select("node"), same).select("node", F.col("comp").alias("community_id"))


def modularity(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """Sum over communities of (edges inside / m) - (degree / 2m)^2; adj holds both directions."""
    a, b = labels.toDF("src", "la"), labels.toDF("dst", "lb")
    tagged = adj.select("src", "dst").join(a, "src").join(b, "dst")
    per = tagged.groupBy(F.col("la").alias("community")).agg(
        row_count("deg"), F.count_if(F.col("la") == F.col("lb")).alias("inside")
    )
    deg, inside = F.col("deg"), F.col("inside")
    sums = per.agg(row_count("communities"), F.sum(deg).alias("d"), F.sum(inside).alias("i"), F.sum(deg.cast("double") * deg).alias("s"))
    return sums.select("communities", F.round(F.col("i") / F.col("d") - F.col("s") / F.pow("d", F.lit(2)), 6).alias("modularity"))


def centrality_batch(adj: DataFrame, persons: DataFrame, previous: DataFrame | None, metrics: list[str], sampling: int) -> DataFrame:
    """Selected scores per person; a score that was not computed keeps its previous value."""
    known = {
        "pagerank": lambda: pagerank(adj).withColumnRenamed("rank", "pagerank"),
        "degree": lambda: degree(adj),
        "betweenness": lambda: betweenness(adj, sampling),
    }
    unknown = set(metrics) - set(known)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    out = persons.select("uuid", F.concat(F.lit("Person:"), "uuid").alias("node"))
    for m in metrics:
        out = out.join(known[m]().select("node", F.col(m).cast("double").alias(f"next_{m}")), "node", "left")
    if previous is not None:
        out = out.join(previous, "uuid", "left")
    final = []
    for m in known:
        new = F.col(f"next_{m}") if m in metrics else F.lit(None).cast("double")
        old = F.col(m).cast("double") if previous is not None and m in previous.columns else F.lit(None).cast("double")
        final.append(F.coalesce(new, old).alias(m))
    return out.select("uuid", *final)
