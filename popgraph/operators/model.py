"""Graph model: node and edge tables derived from persons, hobbies and skills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.operators.prep import split_items
from popgraph.schema import LIST_RELATIONS, SINGLE_RELATIONS


def edges(persons: DataFrame, hobbies: DataFrame, skills: DataFrame) -> DataFrame:
    """edges(src, src_label, rel, dst, dst_label): one pass over persons gives all single-valued traits."""
    traits = F.array(
        *[
            F.struct(F.lit(rel).alias("rel"), F.col(c).alias("dst"), F.lit(label).alias("dst_label"))
            for rel, (c, label) in SINGLE_RELATIONS.items()
        ]
    )
    single = (
        persons.select(F.col("uuid").alias("src"), F.explode(traits).alias("t"))
        .select("src", F.lit("Person").alias("src_label"), "t.rel", "t.dst", "t.dst_label")
        .where(F.col("dst").isNotNull() & (F.col("dst") != ""))
    )
    listed = [
        _pairs(df, rel) for df, rel in ((hobbies, "ENJOYS_HOBBY"), (skills, "HAS_SKILL"))
    ]
    places = persons.select("district_key", "province", "country").distinct()
    in_province = places.select(
        F.col("district_key").alias("src"), F.lit("District").alias("src_label"),
        F.lit("IN_PROVINCE").alias("rel"), F.col("province").alias("dst"), F.lit("Province").alias("dst_label"),
    ).distinct()
    in_country = places.select(
        F.col("province").alias("src"), F.lit("Province").alias("src_label"),
        F.lit("IN_COUNTRY").alias("rel"), F.col("country").alias("dst"), F.lit("Country").alias("dst_label"),
    ).distinct()
    out = single
    for part in [*listed, in_province, in_country]:
        out = out.unionByName(part)
    return out


def _pairs(df: DataFrame, rel: str) -> DataFrame:
    column, label = LIST_RELATIONS[rel]
    return df.select(
        F.col("uuid").alias("src"), F.lit("Person").alias("src_label"), F.lit(rel).alias("rel"),
        F.col(column).alias("dst"), F.lit(label).alias("dst_label"),
    ).distinct()


def nodes(persons: DataFrame, hobbies: DataFrame, skills: DataFrame) -> DataFrame:
    """nodes(label, key, name): persons and the 12 trait labels, each key once."""
    traits = [
        F.struct(F.lit(label).alias("label"), F.col(c).alias("key"), F.col("district" if label == "District" else c).alias("name"))
        for c, label in SINGLE_RELATIONS.values()
    ]
    traits += [
        F.struct(F.lit(label).alias("label"), F.col(c).alias("key"), F.col(c).alias("name"))
        for c, label in (("province", "Province"), ("country", "Country"))
    ]
    single = persons.select(F.explode(F.array(*traits)).alias("t")).select("t.*")
    people = persons.select(
        F.lit("Person").alias("label"), F.col("uuid").alias("key"), F.col("display_name").alias("name")
    )
    out = single.where(F.col("key").isNotNull() & (F.col("key") != "")).distinct()
    for df, rel in ((hobbies, "ENJOYS_HOBBY"), (skills, "HAS_SKILL")):
        c, label = LIST_RELATIONS[rel]
        out = out.unionByName(
            df.select(F.lit(label).alias("label"), F.col(c).alias("key"), F.col(c).alias("name")).distinct()
        )
    return people.unionByName(out)


def likes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Person-item pairs read from a free text."""
    return texts.select(F.col(key).alias("uuid"), F.explode(split_items(F.col(text))).alias("item")).distinct()


def duplicate_keys(node_table: DataFrame) -> DataFrame:
    return (
        node_table.groupBy("label", "key").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    )


def count_by_label(node_table: DataFrame) -> DataFrame:
    return node_table.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))


def node_id(label, key):
    return F.concat_ws(":", label, key)


def undirected(edge_table: DataFrame, rels: list[str] | None = None) -> DataFrame:
    """Both directions of every edge as (src, dst) of typed node ids."""
    kept = edge_table if rels is None else edge_table.where(F.col("rel").isin(rels))
    both = F.array(
        F.struct(
            node_id(F.col("src_label"), F.col("src")).alias("src"), node_id(F.col("dst_label"), F.col("dst")).alias("dst")
        ),
        F.struct(
            node_id(F.col("dst_label"), F.col("dst")).alias("src"), node_id(F.col("src_label"), F.col("src")).alias("dst")
        ),
    )
    return kept.select("rel", F.explode(both).alias("e")).select("rel", "e.src", "e.dst")


def projection_counts(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    n = node_table.agg(F.count(F.lit(1)).alias("cnt")).select(F.lit("nodes").alias("part"), "cnt")
    e = undirected(edge_table).agg(F.count(F.lit(1)).alias("cnt")).select(F.lit("relationships").alias("part"), "cnt")
    return n.unionByName(e)


def with_vectors(node_table: DataFrame, vectors: DataFrame) -> DataFrame:
    """Person nodes with the vector they carry, if any."""
    people = node_table.where(F.col("label") == "Person")
    return people.join(vectors.select(F.col("uuid").alias("key"), "embedding"), "key", "left")
