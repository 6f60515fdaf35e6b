"""Ego networks and shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popgraph.operators.model import node_id
from popgraph.session import cut_lineage

SHARED_LABELS = ["Hobby", "Skill", "District"]
NEXT_LABELS = [*SHARED_LABELS, "Occupation"]


def depth1(edges: DataFrame, uuid: str, similar: DataFrame | None = None) -> DataFrame:
    """All edges at a person; similarity edges only on request."""
    out = edges.where((F.col("src_label") == "Person") & (F.col("src") == uuid)).select(
        F.lit(f"Person:{uuid}").alias("a"), F.col("rel"), node_id(F.col("dst_label"), F.col("dst")).alias("b")
    )
    if similar is not None:
        near = similar.where((F.col("src") == uuid) | (F.col("dst") == uuid)).select(
            F.lit(f"Person:{uuid}").alias("a"), F.lit("SIMILAR_TO").alias("rel"),
            F.concat(F.lit("Person:"), F.when(F.col("src") == uuid, F.col("dst")).otherwise(F.col("src"))).alias("b"),
        )
        out = out.unionByName(near.distinct())
    return out


def _person_edges(edges: DataFrame, labels: list[str]) -> DataFrame:
    return edges.where((F.col("src_label") == "Person") & F.col("dst_label").isin(labels)).select(
        F.col("src").alias("person"), "rel", node_id(F.col("dst_label"), F.col("dst")).alias("entity")
    )


def depth2(edges: DataFrame, uuid: str, limit: int) -> DataFrame:
    """Persons who share a hobby, skill or district with the centre, first `limit` by entity and person."""
    e = _person_edges(edges, SHARED_LABELS)
    mine = e.where(F.col("person") == uuid).select("entity")
    others = e.where(F.col("person") != uuid).join(mine, "entity")
    return others.orderBy("entity", "person").limit(max(limit, 0)).select(
        F.col("entity").alias("a"), "rel", F.concat(F.lit("Person:"), "person").alias("b")
    )


def depth3(edges: DataFrame, uuid: str, limit: int) -> DataFrame:
    """Further traits of those persons, other than the one that connects them.

    A person reached through one entity only must not report that entity; a person reached through
    several reports all of them. So (person, number of connecting entities) decides, without forming
    one row per connecting pair.
    """
    e = _person_edges(edges, SHARED_LABELS)
    mine = e.where(F.col("person") == uuid).select("entity")
    via = e.where(F.col("person") != uuid).join(mine, "entity").groupBy("person").agg(
        F.count(F.lit(1)).alias("n_via"), F.min("entity").alias("only_via")
    )
    nxt = _person_edges(edges, NEXT_LABELS).join(via, "person")
    kept = nxt.where((F.col("n_via") > 1) | (F.col("entity") != F.col("only_via")))
    return kept.orderBy("person", "entity").limit(max(limit, 0)).select(
        F.concat(F.lit("Person:"), "person").alias("a"), "rel", F.col("entity").alias("b")
    )


def subgraph_edges(edges: DataFrame, uuid: str, depth: int, max_nodes: int, similar: DataFrame | None = None) -> DataFrame:
    """Edges (depth, a, rel, b) up to the depth, each level limited to the node budget that is left."""
    if not 1 <= depth <= 3 or not 1 <= max_nodes <= 200:
        raise ValueError("depth must be 1..3 and max_nodes 1..200")
    first = depth1(edges, uuid, similar).withColumn("depth", F.lit(1))
    if depth == 1:
        return first
    left = max(max_nodes - 1 - first.count(), 0)
    second = depth2(edges, uuid, left).withColumn("depth", F.lit(2))
    out = first.unionByName(second)
    if depth == 3:
        left = max(left - second.count(), 0)
        out = out.unionByName(depth3(edges, uuid, left).withColumn("depth", F.lit(3)))
    return out


def assemble(sub: DataFrame, uuid: str, max_nodes: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): each node once, the centre and the first others kept, dangling edges dropped."""
    centre = f"Person:{uuid}"
    ends = sub.select("depth", F.explode(F.array("a", "b")).alias("node"))
    seen = ends.where(F.col("node") != centre).groupBy("node").agg(F.min("depth").alias("depth"))
    others = seen.orderBy("depth", "node").limit(max_nodes - 1)
    first = sub.sparkSession.createDataFrame([(centre, 0)], "node string, depth int")
    nodes = first.unionByName(others)
    keep = nodes.select("node")
    kept = sub.join(keep.withColumnRenamed("node", "a"), "a", "left_semi").join(
        keep.withColumnRenamed("node", "b"), "b", "left_semi"
    )
    return nodes, kept.select("a", "rel", "b").distinct()


def shortest_path(adj: DataFrame, start: str, goal: str, max_depth: int) -> DataFrame:
    """(step, node) of one shortest path, empty when there is none within max_depth.

    Two searches meet in the middle, the smaller frontier moves first; each node keeps its lowest
    parent and the lowest meeting node is used, so the answer does not depend on row order.
    """
    if start == goal:
        raise ValueError("start and goal must differ")
    if not 1 <= max_depth <= 6:
        raise ValueError("max_depth must be between 1 and 6")
    spark = adj.sparkSession
    links = adj.select("src", "dst")
    seed = "node string, parent string, d int"
    sides = [
        {"all": spark.createDataFrame([(start, None, 0)], seed), "d": 0, "size": 1},
        {"all": spark.createDataFrame([(goal, None, 0)], seed), "d": 0, "size": 1},
    ]
    for side in sides:
        side["front"] = side["all"]
    for total in range(1, max_depth + 1):
        side = min(sides, key=lambda s: s["size"])
        step = side["front"].select(F.col("node").alias("src")).join(links, "src").groupBy(F.col("dst").alias("node")).agg(
            F.min("src").alias("parent")
        )
        side["d"] += 1
        side["front"] = cut_lineage(
            step.join(side["all"].select("node"), "node", "left_anti").withColumn("d", F.lit(side["d"]))
        )
        side["size"] = side["front"].count()
        side["all"] = side["all"].unionByName(side["front"])
        if side["size"] == 0:
            break
        met = sides[0]["all"].select("node").join(sides[1]["front"].select("node") if side is sides[1] else sides[1]["all"].select("node"), "node")
        meeting = met.agg(F.min("node")).first()[0]
        if meeting is not None:
            head = _walk(sides[0]["all"], meeting)[::-1]
            tail = _walk(sides[1]["all"], meeting)[1:]
            return spark.createDataFrame(list(enumerate(head + tail)), "step int, node string")
    return spark.createDataFrame([], "step int, node string")


def _walk(table: DataFrame, node: str) -> list[str]:
    """Nodes from `node` back to the search's start; at most max_depth single-row lookups."""
    out = [node]
    while True:
        parent = table.where(F.col("node") == out[-1]).select("parent").first()[0]
        if parent is None:
            return out
        out.append(parent)


def render_path(path: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node of a path as "name (label)" with the relation that leads on."""
    w = Window.orderBy("step")
    steps = path.withColumn("next", F.lead("node").over(w))
    a, b = node_id(F.col("src_label"), F.col("src")), node_id(F.col("dst_label"), F.col("dst"))
    known = edges.select(F.explode(F.array(F.struct(a.alias("node"), b.alias("next")), F.struct(b.alias("node"), a.alias("next")))).alias("e"), "rel")
    rel = F.broadcast(steps).join(known.select("e.node", "e.next", "rel"), ["node", "next"], "left").groupBy("step", "node").agg(F.min("rel").alias("edge"))
    parts = F.split("node", ":", 2)
    return rel.select("step", F.concat(F.get(parts, F.lit(1)), F.lit(" ("), F.get(parts, F.lit(0)), F.lit(")")).alias("text"), "edge")
