"""The recommender's shared tables, each built once from interactions and contexts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.operators import candidates as cand
from popgraph.operators import features, interactions
from popgraph.session import cut_lineage

POOL_SIZE = 50
POOL_ORDER = ["popularity", "cooccurrence"]


class Workspace:
    def __init__(self, edges: DataFrame, contexts: DataFrame):
        self.edges, self.contexts = edges, contexts

    @cached_property
    def split(self) -> DataFrame:
        return cut_lineage(interactions.split_by_person(self.edges))

    def part(self, name: str) -> DataFrame:
        return self.split.where(F.col("split") == name).select("uuid", "item")

    @cached_property
    def train(self) -> DataFrame:
        return self.part("train")

    @cached_property
    def pop(self) -> DataFrame:
        return cut_lineage(interactions.popularity(self.train))

    @cached_property
    def cooc(self) -> DataFrame:
        return cut_lineage(interactions.cooccurrence(self.train))

    @cached_property
    def histogram(self) -> DataFrame:
        return cut_lineage(interactions.field_histogram(self.train, self.contexts))

    @cached_property
    def persons(self) -> DataFrame:
        return self.split.select("uuid").distinct()

    def weights(self, kind: str) -> DataFrame:
        return cand.item_weights(kind, self.cooc, self.pop, self.train)

    def provider(self, name: str, k: int = POOL_SIZE) -> DataFrame:
        if name == "popularity":
            return cand.popularity_candidates(self.persons, self.train, self.pop, k)
        if name == "segment_popularity":
            mine = self.contexts.join(self.persons.withColumnRenamed("uuid", "person_uuid"), "person_uuid", "left_semi")
            return cand.segment_candidates(mine, self.train, self.histogram, self.pop, k)
        return cand.item_item(self.train, self.weights(name), self.pop, name, k)

    @cached_property
    def normalized(self) -> DataFrame:
        both = self.provider("popularity").unionByName(self.provider("cooccurrence"))
        return cand.normalize_scores(both)

    @cached_property
    def pool(self) -> DataFrame:
        """Stage-1 pool: popularity and co-occurrence, normalised and merged."""
        return cut_lineage(cand.merge(self.normalized, POOL_SIZE, POOL_ORDER))

    @cached_property
    def item_profile(self) -> DataFrame:
        return cut_lineage(features.item_profile(self.pop, self.histogram, self.cooc))

    def features(self, pairs: DataFrame) -> DataFrame:
        return features.build(pairs, self.contexts, self.train, self.item_profile)

    @cached_property
    def pool_features(self) -> DataFrame:
        return self.features(self.pool)

    @cached_property
    def reranked(self) -> DataFrame:
        return features.rerank(self.pool_features)

    @cached_property
    def stage1(self) -> DataFrame:
        """Stage-1 lists: the pool in its own order."""
        return self.pool.select("uuid", "item", F.col("score"), "rnk")
