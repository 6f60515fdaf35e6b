"""Text vectors: encoding each distinct text once, item vectors and similarity features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashing_encoder(dim: int = 256) -> Callable[[DataFrame], DataFrame]:
    """Default encoder: hashed term frequencies of unit length, computed by the JVM."""

    def encode(texts: DataFrame) -> DataFrame:
        words = RegexTokenizer(inputCol="text", outputCol="__w", pattern=r"\s+").transform(texts)
        tf = HashingTF(inputCol="__w", outputCol="__tf", numFeatures=dim).transform(words)
        unit = Normalizer(inputCol="__tf", outputCol="__unit", p=2.0).transform(tf)
        return unit.select("text_key", vector_to_array("__unit").alias("embedding"))

    return encode


def embed_texts(rows: DataFrame, cache: DataFrame | None, encoder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows(uuid, text) with a vector; a text that repeats or is in the cache is not encoded again.

    Texts travel by hash: the distinct step and both joins move 32-character keys, a text itself is
    moved once, to the encoder.
    """
    keyed = rows.withColumn("text_key", F.sha2("text", 256))
    todo = keyed.groupBy("text_key").agg(F.first("text").alias("text"))
    if cache is not None:
        todo = todo.join(cache.select("text_key"), "text_key", "left_anti")
    vectors = encoder(todo)
    if cache is not None:
        vectors = vectors.unionByName(cache.select("text_key", "embedding"))
    return keyed.select("uuid", "text_key").join(vectors, "text_key").select("uuid", "text_key", "embedding")


def category_vectors(items: DataFrame, categories: list[str]) -> DataFrame:
    """Unit one-hot vector of each item's category; an unknown category gives the zero vector."""
    hot = F.array(*[F.when(F.col("category") == c, 1.0).otherwise(0.0) for c in categories])
    return items.select("item", hot.alias("embedding"))


def similarity_features(matrix: DataFrame, items: list[str]) -> DataFrame:
    """One similarity column per item of a (uuid, item, similarity) table."""
    return matrix.groupBy("uuid").pivot("item", items).agg(F.max("similarity")).select(
        "uuid", *[F.coalesce(F.col(i), F.lit(0.0)).alias(f"text_sim_{i}") for i in items]
    )


def positive_similarities(matrix: DataFrame) -> DataFrame:
    return matrix.where(F.col("similarity") > 0)


def similarity_summary(matrix: DataFrame) -> DataFrame:
    """Rows, columns, cells and share of positive cells."""
    return matrix.agg(
        F.count_distinct("uuid").alias("persons"), F.count_distinct("item").alias("items"),
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("similarity") > 0).alias("positive"),
    ).withColumn("positive_ratio", F.round(F.col("positive") / F.col("cells"), 6))


def centroids(vectors: DataFrame, label: str) -> DataFrame:
    """Mean vector per label."""
    sums = vectors.select(label, F.posexplode("embedding").alias("pos", "x")).groupBy(label, "pos").agg(
        F.avg(F.col("x").cast("double")).alias("x")
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return sums.groupBy(label).agg(ordered.alias("embedding"))
