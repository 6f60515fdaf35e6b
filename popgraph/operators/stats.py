"""Distributions, overview, segment comparison and data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popgraph.functions.columns import ratio, row_count, top_n, top_n_global
from popgraph.schema import DIMENSIONS
from popgraph.session import cut_lineage

OVERVIEW_LIMIT = 20
LIMITED_SECTIONS = ["occupation", "hobby", "skill"]


def total(persons: DataFrame) -> DataFrame:
    return persons.agg(F.count(F.lit(1)).alias("total"))


def dimension_values(dimension: str, persons: DataFrame, hobbies: DataFrame, skills: DataFrame) -> DataFrame:
    """(uuid, label) of one dimension; hobby and skill rows are limited to the given persons."""
    if dimension not in DIMENSIONS:
        raise ValueError(f"unknown dimension {dimension}; use one of {', '.join(sorted(DIMENSIONS))}")
    if dimension in ("hobby", "skill"):
        pairs, column = (hobbies, "item") if dimension == "hobby" else (skills, "skill")
        return pairs.join(persons.select("uuid"), "uuid", "left_semi").select("uuid", F.col(column).alias("label"))
    return persons.select("uuid", F.col(DIMENSIONS[dimension]).alias("label")).where(F.col("label").isNotNull())


def distribution(persons: DataFrame, column: str) -> DataFrame:
    """Counts per value and their share of all persons, nulls left out.

    The total is the sum over the grouped rows (nulls included), so the table is read once.
    """
    counts = persons.groupBy(F.col(column).alias("label")).agg(row_count())
    everyone = F.sum("cnt").over(Window.partitionBy())
    return (
        counts.withColumn("ratio_of_total", ratio(F.col("cnt"), everyone))
        .where(F.col("label").isNotNull())
    )


def top_values(values: DataFrame, limit: int) -> DataFrame:
    counts = values.groupBy("label").agg(row_count())
    return top_n_global(counts, [F.desc("cnt"), F.asc("label")], limit)


def dimension_distribution(values: DataFrame, limit: int, digits: int | None = 4) -> DataFrame:
    """Top labels with their share of the labels shown."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    shown = F.sum("cnt").over(Window.partitionBy())
    share = F.col("cnt") / shown
    top = top_values(values, limit)
    return top.withColumn("ratio_of_shown", share if digits is None else F.round(share, digits))


def overview(persons: DataFrame, hobbies: DataFrame, skills: DataFrame) -> DataFrame:
    """All overview distributions as (section, label, cnt, ratio); persons are read in one pass.

    Occupations, hobbies and skills show their OVERVIEW_LIMIT commonest labels, all other sections every label.
    """
    sections = {
        "age": "age_group", "sex": "sex", "province": "province", "education": "education_level",
        "marital": "marital_status", "occupation": "occupation",
    }
    tagged = F.array(
        F.struct(F.lit("total").alias("section"), F.lit("all").alias("label")),
        *[F.struct(F.lit(s).alias("section"), F.col(c).alias("label")) for s, c in sections.items()],
    )
    person_counts = (
        persons.select(F.explode(tagged).alias("t")).select("t.*").where(F.col("label").isNotNull())
        .groupBy("section", "label").agg(row_count())
    )
    pairs = hobbies.select(F.lit("hobby").alias("section"), F.col("item").alias("label")).unionByName(
        skills.select(F.lit("skill").alias("section"), F.col("skill").alias("label"))
    )
    counts = person_counts.unionByName(pairs.groupBy("section", "label").agg(row_count()))
    counts = cut_lineage(counts)
    limited = F.col("section").isin(LIMITED_SECTIONS)
    top = top_n(counts.where(limited), ["section"], [F.desc("cnt"), F.asc("label")], OVERVIEW_LIMIT)
    ranked = counts.where(~limited).unionByName(top.select(*counts.columns))
    # one row per label of small domains is left here, the total among them
    everyone = F.max(F.when(F.col("section") == "total", F.col("cnt"))).over(Window.partitionBy())
    return ranked.select("section", "label", "cnt", ratio(F.col("cnt"), everyone).alias("ratio_of_total"))


def compare(
    dims: list[str], a: DataFrame, b: DataFrame, hobbies: DataFrame, skills: DataFrame, top_k: int
) -> DataFrame:
    """Per dimension and label: counts and shares in both segments and whether it is common or one-sided."""
    out = None
    for dim in dims:
        sides = []
        for name, persons in (("a", a), ("b", b)):
            d = dimension_distribution(dimension_values(dim, persons, hobbies, skills), top_k, digits=None)
            sides.append(d.select("label", F.col("cnt").alias(f"cnt_{name}"), F.col("ratio_of_shown").alias(f"ratio_{name}")))
        joined = sides[0].join(sides[1], "label", "full_outer").select(
            F.lit(dim).alias("dimension"), "label",
            F.coalesce("cnt_a", F.lit(0)).alias("cnt_a"), F.round(F.coalesce("ratio_a", F.lit(0.0)), 6).alias("ratio_a"),
            F.coalesce("cnt_b", F.lit(0)).alias("cnt_b"), F.round(F.coalesce("ratio_b", F.lit(0.0)), 6).alias("ratio_b"),
            F.when(F.col("cnt_a").isNull(), "only_b").when(F.col("cnt_b").isNull(), "only_a").otherwise("common").alias("side"),
        )
        out = joined if out is None else out.unionByName(joined)
    return out


# Fixed thresholds of the distribution-quality ladder.
SKEW_HIGH, SKEW_REVIEW = 0.9, 0.75


def quality_check(values: DataFrame) -> DataFrame:
    """Cardinality, total, dominant share and advice per checked column; values = (name, label, single, skewed)."""
    per_value = values.groupBy("name", "single_action", "skew_action", "label").agg(row_count())
    agg = per_value.groupBy("name", "single_action", "skew_action").agg(
        F.count(F.lit(1)).alias("cardinality"), F.sum("cnt").alias("total"), F.max("cnt").alias("top")
    )
    share = F.col("top") / F.col("total")
    return agg.select(
        "name", "cardinality", "total", F.round(share, 4).alias("dominant_ratio"),
        F.when(F.col("cardinality") <= 1, F.col("single_action"))
        .when(share >= SKEW_HIGH, F.col("skew_action"))
        .when(share >= SKEW_REVIEW, "review").otherwise("keep").alias("action"),
        F.when(F.col("cardinality") <= 1, "high").when(share >= SKEW_HIGH, "medium")
        .when(share >= SKEW_REVIEW, "low").otherwise("none").alias("severity"),
    )


def structure_checks(edges: DataFrame) -> DataFrame:
    """Every district has one province edge; edges and nodes at the country."""
    in_province = edges.where(F.col("rel") == "IN_PROVINCE").agg(
        F.count(F.lit(1)).alias("province_edges"), F.count_distinct("src").alias("districts")
    )
    to_country = edges.where(F.col("dst_label") == "Country").agg(
        F.count(F.lit(1)).alias("country_edges"), F.count_distinct("rel").alias("country_relations"),
        F.count_distinct("dst").alias("countries"),
    )
    long = [
        (in_province, ["province_edges", "districts"]), (to_country, ["country_edges", "country_relations", "countries"]),
    ]
    out = None
    for df, names in long:
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).select("m.*")
        out = rows if out is None else out.unionByName(rows)
    return out
