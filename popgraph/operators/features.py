"""Rerank features and the deterministic reranker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgraph.functions.skew import join_measured
from popgraph.operators.interactions import demographic_key, known_lists, top_cooccurring
from popgraph.operators.vocabulary import rule_match

# Fixed default weights of the linear score.
WEIGHTS = {
    "lightgcn_score": 0.25,
    "cooccurrence_score": 0.10,
    "segment_popularity_score": 0.20,
    "similar_person_score": 0.0,
    "persona_text_fit": 0.0,
    "known_hobby_compatibility": 0.15,
    "age_group_fit": 0.10,
    "occupation_fit": 0.10,
    "region_fit": 0.05,
    "popularity_prior": 0.03,
    "mismatch_penalty": 0.25,
    "popularity_penalty": 0.0,
    "novelty_bonus": 0.0,
    "category_diversity_reward": 0.0,
    "is_cold_start": 0.0,
}
SUBTRACTED = ("mismatch_penalty", "popularity_penalty")
FEATURES = [*WEIGHTS, "source_is_popularity", "source_is_cooccurrence", "source_count", "text_embedding_similarity"]
FIT_FIELDS = ["age_group", "occupation", "province", "district", "sex"]
TEXT_FIELDS = [
    "persona_text", "professional_text", "sports_text", "arts_text", "travel_text", "culinary_text", "family_text",
]
MISMATCH_BELOW = 0.05


def item_profile(pop: DataFrame, histogram: DataFrame, cooc: DataFrame) -> DataFrame:
    """One row per item: popularity, value shares as a map, the 20 items most often held with it.

    The maps are bounded by the number of demographic values and by 20, not by the number of persons.
    """
    shares = histogram.where(F.col("field").isin(FIT_FIELDS)).groupBy("item").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("=", "field", "value").alias("k"), "share"))).alias("shares")
    )
    top = top_cooccurring(cooc).groupBy(F.col("src").alias("item")).agg(
        F.collect_list(F.struct("dst", "c")).alias("cooc_top"), F.sum("c").alias("cooc_total")
    )
    return pop.withColumn("max_pop", F.lit(pop.agg(F.max("pop")).first()[0])).join(shares, "item", "left").join(top, "item", "left")


def _fit(field: str, value: Column) -> Column:
    share = F.when(F.col("shares").isNotNull() & (value != ""), F.try_element_at("shares", demographic_key(field, value)))
    return F.coalesce(share, F.lit(0.0))


def build(
    pairs: DataFrame, contexts: DataFrame, known: DataFrame, profile: DataFrame,
    text_similarity: DataFrame | None = None, use_text_fit: bool = False, keep: list[str] | None = None,
) -> DataFrame:
    """All features of (uuid, item, source_scores) rows; columns named in `keep` stay beside them.

    Persons' contexts and known lists meet the pairs by person; the item profile is measured and
    broadcast. `has_context` is false where only the stage-1 score can be used.
    """
    ctx_cols = [*FIT_FIELDS, *(TEXT_FIELDS if use_text_fit else [])]
    ctx = contexts.select(F.col("person_uuid").alias("uuid"), *ctx_cols, F.lit(True).alias("has_context"))
    met = pairs
    if text_similarity is not None:  # before the rows carry the item profile
        met = met.join(text_similarity.select("uuid", "item", F.col("similarity").alias("__text")), ["uuid", "item"], "left")
    joined = met.join(ctx, "uuid", "left").join(known_lists(known), "uuid", "left")
    items = pairs.select("item").distinct().join(profile, "item", "left")
    rows = join_measured(joined, items, "item", "uuid")
    zero = F.lit(0.0)
    no_items = F.array().cast("array<string>")
    known_c = F.coalesce("known", no_items)

    def source(name):
        return F.coalesce(F.try_element_at("source_scores", F.lit(name)), zero)

    def has(name):
        return F.coalesce(F.map_contains_key("source_scores", F.lit(name)), F.lit(False)).cast("double")

    matched = F.aggregate(
        "cooc_top", F.lit(0).cast("long"), lambda acc, x: acc + F.when(F.array_contains(known_c, x["dst"]), x["c"]).otherwise(F.lit(0).cast("long"))
    )
    compat = F.when((F.size(known_c) > 0) & (F.col("cooc_total") > 0), matched / F.col("cooc_total"))
    pop = F.coalesce(F.col("pop"), F.lit(0)).cast("double")
    biggest = F.coalesce("max_pop", F.lit(0)).cast("double")
    penalty = F.when(biggest > 0, F.log1p(pop) / F.log1p(biggest)).otherwise(zero)
    fits = {f: _fit(f, F.col(f)) for f in FIT_FIELDS}
    misfit = zero
    for f in ("age_group", "occupation", "sex"):
        # every item seen in train has all demographic histograms, so a profile row is what it takes
        applies = F.col("shares").isNotNull() & (F.col(f) != "") & (fits[f] < MISMATCH_BELOW)
        misfit = misfit + F.when(F.coalesce(applies, F.lit(False)), 1 - fits[f]).otherwise(zero)
    text_fit = (
        F.concat_ws(" ", *TEXT_FIELDS).contains(F.col("item")).cast("double") if use_text_fit else zero
    )
    columns = {
        "lightgcn_score": source("lightgcn"),
        "cooccurrence_score": source("cooccurrence"),
        "segment_popularity_score": source("segment_popularity"),
        "similar_person_score": zero,
        "persona_text_fit": F.coalesce(text_fit, zero),
        "known_hobby_compatibility": F.coalesce(compat, zero),
        "age_group_fit": fits["age_group"],
        "occupation_fit": fits["occupation"],
        "region_fit": F.greatest(fits["province"], fits["district"]),
        "popularity_prior": F.when(biggest > 0, pop / biggest).otherwise(zero),
        "mismatch_penalty": misfit / 3,
        "popularity_penalty": penalty,
        "novelty_bonus": 1 - penalty,
        "category_diversity_reward": zero,
        "is_cold_start": (F.size(known_c) <= 1).cast("double"),
        "source_is_popularity": has("popularity"),
        "source_is_cooccurrence": has("cooccurrence"),
        "source_count": has("popularity") + has("cooccurrence"),
        "text_embedding_similarity": F.coalesce(F.col("__text"), zero) if text_similarity is not None else zero,
    }
    return rows.select(
        "uuid", "item", "source_scores", F.coalesce("has_context", F.lit(False)).alias("has_context"),
        *(keep or []), *[c.alias(n) for n, c in columns.items()],
    )


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    unknown = set(weights) - set(WEIGHTS)
    if unknown:
        raise ValueError(f"unknown reranker weights: {sorted(unknown)}")
    return {**WEIGHTS, **weights}


def linear_score(weights: dict[str, float] | None = None) -> Column:
    out = F.lit(0.0)
    for name, w in check_weights(weights or {}).items():
        if w:
            out = out - w * F.col(name) if name in SUBTRACTED else out + w * F.col(name)
    return out


def stage1_score() -> Column:
    values = F.map_values("source_scores")
    return F.coalesce(F.when(F.size(values) > 0, F.array_max(values)), F.lit(0.0))


def rerank(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Score and position per person; persons without context keep their best stage-1 score."""
    # rounding makes the order independent of how the sum was evaluated
    score = F.round(F.when(F.col("has_context"), linear_score(weights)).otherwise(stage1_score()), 9)
    w = Window.partitionBy("uuid").orderBy(F.desc("score"), F.asc("item"))
    return rows.withColumn("score", score).withColumn("rnk", F.row_number().over(w))


def category_resort(ranked: DataFrame, categories: DataFrame, reward: float, k: int = 50) -> DataFrame:
    """Greedy order that rewards the first item of each category, as two window passes.

    While a category is unseen all its items carry the reward, so its best item is taken first and the
    others fall back to their score. The greedy order is therefore the order by score, the best item of
    each category raised by the reward.
    """
    rows = ranked.where(F.col("rnk") <= k).select("uuid", "item", "score").join(categories.select("item", "category"), "item", "left")
    first = F.row_number().over(Window.partitionBy("uuid", "category").orderBy(F.desc("score"), F.asc("item"))) == 1
    named = F.coalesce("category", F.lit("")) != ""
    rows = rows.withColumn("fresh", (first & named).cast("int"))
    adjusted = F.round(F.col("score") + reward * F.col("fresh"), 12)
    order = Window.partitionBy("uuid").orderBy(F.desc(adjusted), F.desc("fresh"), F.asc("item"))
    return rows.select("uuid", "item", "score", F.row_number().over(order).alias("rnk"))


def item_category(items: DataFrame, mapped: DataFrame, rules: list[dict]) -> DataFrame:
    """Category by the taxonomy map, else by the first rule that yields the name, else blank."""
    joined = items.select("item").join(mapped.select("item", F.col("category").alias("mapped")), "item", "left")
    return joined.select("item", F.coalesce("mapped", rule_match(F.col("item"), rules, "category"), F.lit("")).alias("category"))
