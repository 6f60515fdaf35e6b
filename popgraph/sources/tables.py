"""Adapter: the star-schema tables seen as persons, traits, interactions, texts and vectors."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popgraph.functions.columns import blank_to_null, null_to_blank
from popgraph.operators import knn, model, prep
from popgraph.operators.workspace import Workspace
from popgraph.schema import COUNTRY, NOT_APPLICABLE, PERSONA_TEXTS
from popgraph.session import tune
from popgraph.sources.files import stored

HOBBY_MIN_QUANTITY = 45
SKILL_MAX_QUANTITY = 5


class Tables:
    """Lazy views over one data folder; nothing is read until a plan that uses it runs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def persons(self) -> DataFrame:
        k = F.col("c_custkey")

        def code(prefix, n):
            return F.concat(F.lit(prefix), (k % n).cast("string"))

        age = (F.lit(19) + k % 81).cast("int")
        return (
            self.raw("customer")
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                k.cast("string").alias("uuid"),
                F.col("c_name").alias("display_name"),
                age.alias("age"),
                prep.age_group(age).alias("age_group"),
                F.when(k % 2 == 0, "여자").otherwise("남자").alias("sex"),
                F.col("c_mktsegment").alias("occupation"),
                F.col("n_name").alias("district"),
                F.concat_ws("-", "r_name", "n_name").alias("district_key"),
                F.col("r_name").alias("province"),
                F.lit(COUNTRY).alias("country"),
                code("m", 4).alias("marital_status"),
                F.when(k % 20 == 0, "현역").otherwise("비현역").alias("military_status"),
                code("f", 39).alias("family_type"),
                code("h", 6).alias("housing_type"),
                code("e", 7).alias("education_level"),
                F.when(k % 3 != 0, code("b", 10)).alias("bachelors_field"),
            )
        )

    @cached_property
    def texts(self) -> DataFrame:
        """uuid and eight texts: one per line, the last takes every remaining line."""
        lines = F.split("text", "\n")
        last = len(PERSONA_TEXTS) - 1
        cols = [blank_to_null(F.get(lines, F.lit(i))).alias(c) for i, c in enumerate(PERSONA_TEXTS[:last])]
        rest = F.when(
            F.size(lines) > last, F.array_join(F.slice(lines, last + 1, F.greatest(F.size(lines), F.lit(1))), "\n")
        )
        return self.raw("documents").select(
            F.col("doc_id").cast("string").alias("uuid"), *cols, blank_to_null(rest).alias(PERSONA_TEXTS[last])
        )

    def _lines(self, condition) -> DataFrame:
        return (
            self.raw("lineitem")
            .where(condition)
            .join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        )

    def _hobbies(self, condition) -> DataFrame:
        return (
            self._lines(condition)
            .join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("o_custkey").cast("string").alias("uuid"),
                F.concat_ws("/", "p_brand", "p_type").alias("item"),
            )
            .distinct()
        )

    @cached_property
    def hobbies(self) -> DataFrame:
        return self._hobbies(F.col("l_quantity") >= HOBBY_MIN_QUANTITY)

    @cached_property
    def dense_hobbies(self) -> DataFrame:
        return self._hobbies(F.lit(True))

    @cached_property
    def skills(self) -> DataFrame:
        return (
            self._lines(F.col("l_quantity") <= SKILL_MAX_QUANTITY)
            .select(
                F.col("o_custkey").cast("string").alias("uuid"),
                F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("skill"),
            )
            .distinct()
        )

    @cached_property
    def hobby_lists(self) -> DataFrame:
        """uuid and its hobbies in one text; a list is no longer than the item catalogue."""
        return self.hobbies.groupBy("uuid").agg(
            F.array_join(F.sort_array(F.collect_set("item")), "; ").alias("hobbies_text")
        )

    @cached_property
    def contexts(self) -> DataFrame:
        """The 21 context columns of the recommender; blank instead of null."""
        joined = self.persons.join(self.texts, "uuid", "left").join(self.hobby_lists, "uuid", "left")
        texts = {
            "persona_text": "persona",
            "professional_text": "professional_persona",
            "sports_text": "sports_persona",
            "arts_text": "arts_persona",
            "travel_text": "travel_persona",
            "culinary_text": "culinary_persona",
            "family_text": "family_persona",
            "hobbies_text": "hobbies_text",
        }
        same = ["age_group", "sex", "occupation", "district", "province", "family_type", "housing_type", "education_level"]
        return joined.select(
            F.col("uuid").alias("person_uuid"),
            F.col("age").cast("string").alias("age"),
            *[null_to_blank(F.col(c)).alias(c) for c in same],
            *[null_to_blank(F.col(src)).alias(dst) for dst, src in texts.items()],
            F.lit("").alias("skills_text"),
            null_to_blank(F.col("career_goals")).alias("career_goals"),
            F.concat_ws(
                " ",
                *[blank_to_null(F.col(c)) for c in PERSONA_TEXTS[:7]],
                "province",
                "district",
                "occupation",
                "hobbies_text",
            ).alias("embedding_text"),
        )

    @cached_property
    def persona_texts(self) -> DataFrame:
        """Two columns of the contexts, without the joins of the others."""
        return self.persons.select("uuid").join(self.texts.select("uuid", "persona"), "uuid", "left").select(
            F.col("uuid").alias("person_uuid"), null_to_blank(F.col("persona")).alias("persona_text")
        )

    @cached_property
    def demographics(self) -> DataFrame:
        """Contexts without the text columns, for plans that read none."""
        same = ["age_group", "sex", "occupation", "district", "province", "family_type", "housing_type", "education_level"]
        return self.persons.select(F.col("uuid").alias("person_uuid"), *[null_to_blank(F.col(c)).alias(c) for c in same])

    @cached_property
    def reco(self) -> Workspace:
        return Workspace(self.hobbies, self.demographics)

    @cached_property
    def raw_hobbies(self) -> DataFrame:
        """Hobby names as first written: (uuid, raw) with odd spacing and case."""
        rows = self._lines(F.col("l_quantity") >= HOBBY_MIN_QUANTITY).join(
            self.raw("part"), F.col("l_partkey") == F.col("p_partkey")
        )
        spelling = F.when(F.col("l_linenumber") % 3 == 0, F.upper("p_name")).when(
            F.col("l_linenumber") % 3 == 1, F.concat(F.lit(" "), F.regexp_replace("p_name", " ", "  "))
        ).otherwise(F.concat("p_name", F.lit(" "), F.lower("p_type")))
        return rows.select(F.col("o_custkey").cast("string").alias("uuid"), spelling.alias("raw")).distinct()

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").cast("string").alias("uuid"), F.col("embedding"), "label"
        )

    @cached_property
    def conversations(self) -> DataFrame:
        return self.raw("conversations")

    @cached_property
    def raw_personas(self) -> DataFrame:
        """The 26-column raw persona table: text columns, lists as Python literals."""

        def literal(df, value, out):
            joined = F.array_join(F.sort_array(F.collect_set(value)), "', '")
            return df.groupBy("uuid").agg(F.concat(F.lit("['"), joined, F.lit("']")).alias(out))

        names = F.array(F.lit("최은지"), F.lit("김민수"), F.lit("이서연"))
        p = (
            self.persons.join(self.texts, "uuid", "left")
            .join(literal(self.hobbies, "item", "hobbies_and_interests_list"), "uuid", "left")
            .join(literal(self.skills, "skill", "skills_and_expertise_list"), "uuid", "left")
        )
        return p.select(
            "uuid", "professional_persona", "sports_persona", "arts_persona", "travel_persona",
            "culinary_persona", "family_persona",
            F.concat(
                F.element_at(names, (F.col("age") % 3 + 1).cast("int")), F.lit(" 씨는 "), F.coalesce("persona", F.lit(""))
            ).alias("persona"),
            F.lit(None).cast("string").alias("cultural_background"),
            F.lit(None).cast("string").alias("skills_and_expertise"),
            F.coalesce("skills_and_expertise_list", F.lit("[]")).alias("skills_and_expertise_list"),
            F.lit(None).cast("string").alias("hobbies_and_interests"),
            F.coalesce("hobbies_and_interests_list", F.lit("[]")).alias("hobbies_and_interests_list"),
            F.col("career_goals").alias("career_goals_and_ambitions"),
            "sex", F.col("age").cast("long").alias("age"), "marital_status", "military_status", "family_type",
            "housing_type", "education_level",
            F.coalesce("bachelors_field", F.lit(NOT_APPLICABLE)).alias("bachelors_field"),
            "occupation", F.col("district_key").alias("district"), "province", "country",
        )

    @cached_property
    def edges(self) -> DataFrame:
        return model.edges(self.persons, self.hobbies, self.skills)

    @cached_property
    def nodes(self) -> DataFrame:
        return model.nodes(self.persons, self.hobbies, self.skills)

    @cached_property
    def similar(self) -> DataFrame:
        """Stored similarity: five nearest persons by vector."""
        return stored(knn.neighbours(self.vectors.select("uuid", "embedding"), 5))  # plans read it more than once

    @cached_property
    def members(self) -> DataFrame:
        """Community of each person that has a vector."""
        return self.vectors.select("uuid", F.col("label").alias("community_id"))

    @cached_property
    def graph(self) -> DataFrame:
        """The whole projection, both directions of every edge."""
        return model.undirected(self.edges).select("src", "dst")

    @cached_property
    def hobby_graph(self) -> DataFrame:
        return model.undirected(self.edges, ["ENJOYS_HOBBY"]).select("src", "dst")

    @cached_property
    def runs(self) -> DataFrame:
        """Events read as a run log: one job per user, errors are failed runs."""
        return self.raw("events").select(
            F.col("user_id").cast("string").alias("key"),
            F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
            F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("at"),
        )
