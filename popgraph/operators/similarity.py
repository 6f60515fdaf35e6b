"""Similar persons: stored and blended scores, shared traits, graph recommendation, communities, influence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgraph.functions.columns import row_count, top_n, top_n_global


def stored_top(similar: DataFrame, k: int) -> DataFrame:
    return top_n(similar.select("src", "dst", "score"), ["src"], [F.desc("score"), F.asc("dst")], k)


def blended(graph: DataFrame, text: DataFrame, k: int, wg: float = 0.6, wt: float = 0.4) -> DataFrame:
    """Best 2k of each list merged; a person missing from one list scores 0 there."""
    if wg < 0 or wt < 0 or wg + wt <= 0:
        raise ValueError("weights must not be negative and their sum must be positive")
    g = stored_top(graph, 2 * k).select("src", "dst", F.col("score").alias("g"))
    t = stored_top(text, 2 * k).select("src", "dst", F.col("score").alias("t"))
    zero = F.lit(0.0)
    both = g.join(t, ["src", "dst"], "full_outer").select(
        "src", "dst", F.round(wg * F.coalesce("g", zero) + wt * F.coalesce("t", zero), 4).alias("score")
    )
    return top_n(both, ["src"], [F.desc("score"), F.asc("dst")], k)


def shared(pairs: DataFrame, edges: DataFrame, rels: list[str] | None = None) -> DataFrame:
    """Traits both ends of each pair have: (src, dst, rel, label, name)."""
    mine = edges.where(F.col("src_label") == "Person")
    if rels:
        mine = mine.where(F.col("rel").isin(rels))
    left = mine.select(F.col("src"), "rel", F.col("dst_label").alias("label"), F.col("dst").alias("name"))
    right = left.withColumnRenamed("src", "dst")
    return pairs.select("src", "dst").join(left, "src").join(right, ["dst", "rel", "label", "name"]).select(
        "src", "dst", "rel", "label", "name"
    )


def first_names(rows: DataFrame, order: list[str], n: int, out: str, sep: str = ", ") -> DataFrame:
    """First n names per pair in one text; the list is cut before it is collected."""
    top = top_n(rows, ["src", "dst"], [F.asc(c) for c in order], n, rank="__pos")
    names = F.transform(F.sort_array(F.collect_list(F.struct("__pos", "name"))), lambda x: x["name"])
    return top.groupBy("src", "dst").agg(F.array_join(names, sep).alias(out))


def preview(similar: DataFrame, hobbies_edges: DataFrame, persons: DataFrame, k: int = 3) -> DataFrame:
    """Three most similar persons with the hobbies they share."""
    top = stored_top(similar, k)
    common = shared(top, hobbies_edges, ["ENJOYS_HOBBY"]).groupBy("src", "dst").agg(
        F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("shared_hobbies")
    )
    who = persons.select(F.col("uuid").alias("dst"), "display_name", "age")
    return top.join(common, ["src", "dst"], "left").join(who, "dst", "left").select(
        "src", "dst", "display_name", "age", "score", "rnk", F.coalesce("shared_hobbies", F.lit("")).alias("shared_hobbies")
    )


def summary_text(pairs: DataFrame, edges: DataFrame, persons: DataFrame) -> DataFrame:
    """One sentence per pair: up to three shared hobbies and three shared traits."""
    traits = shared(pairs, edges)
    h = first_names(traits.where(F.col("rel") == "ENJOYS_HOBBY"), ["name"], 3, "h")
    a = first_names(traits, ["label", "name"], 3, "a")
    parts = F.concat_ws(
        "; ", F.concat(F.lit("공통 취미: "), F.col("h")), F.concat(F.lit("공통 속성: "), F.col("a"))
    )
    who = persons.select(F.col("uuid").alias("dst"), "display_name")
    joined = pairs.select("src", "dst").join(h, ["src", "dst"], "left").join(a, ["src", "dst"], "left").join(who, "dst", "left")
    named = F.when((parts != "") & F.col("display_name").isNotNull(), F.concat("display_name", F.lit("와(과) "), parts))
    return joined.select("src", "dst", F.coalesce(named, parts).alias("summary"))


# --- graph recommendation -----------------------------------------------------------------------

CATEGORIES = {
    "hobby": "ENJOYS_HOBBY", "skill": "HAS_SKILL", "occupation": "WORKS_AS", "district": "LIVES_IN",
}
# Fixed sentence per category.
REASONS = {
    "hobby": "당신과 유사한 %d명 중 %d%%가 '%s'을(를) 취미로 가지고 있습니다.",
    "skill": "당신과 유사한 %d명 중 %d%%가 '%s' 스킬을 보유하고 있습니다.",
    "occupation": "당신과 유사한 %d명 중 %d%%가 '%s' 직업을 가지고 있습니다.",
    "district": "당신과 유사한 %d명 중 %d%%가 '%s' 지역에 거주하고 있습니다.",
}


def recommend(similar: DataFrame, edges: DataFrame, category: str, top_n_items: int, scores: DataFrame | None = None) -> DataFrame:
    """Items of similar persons that the source lacks, for every source.

    Ordered by the share of similar persons who have the item, then by their summed similarity
    (raised by the influence score if one is given), then by name; up to five supporters each.
    """
    if category not in CATEGORIES:
        raise ValueError(f"unknown category {category}")
    if not 1 <= top_n_items <= 20:
        raise ValueError("top_n must be between 1 and 20")
    has = edges.where(F.col("rel") == CATEGORIES[category]).select("src", F.col("dst").alias("item"))
    sim = similar.select("src", "dst", F.coalesce("score", F.lit(0.0)).alias("similarity"))
    weight = F.col("similarity")
    if scores is not None:
        sim = sim.join(scores.select(F.col("uuid").alias("dst"), "influence"), "dst", "left")
        weight = weight * (1 + F.coalesce("influence", F.lit(0.0)))
    totals = similar.groupBy("src").agg(F.count_distinct("dst").alias("total_similar"))
    offered = sim.withColumn("w", weight).join(has.withColumnRenamed("src", "dst"), "dst").join(has, ["src", "item"], "left_anti")
    best = F.row_number().over(Window.partitionBy("src", "item").orderBy(F.desc("similarity"), F.asc("dst")))
    supporters = F.transform(
        F.sort_array(F.collect_list(F.when(F.col("pos") <= 5, F.struct("pos", "dst")))), lambda x: x["dst"]
    )
    scored = (
        offered.withColumn("pos", best).groupBy("src", "item")
        .agg(F.count(F.lit(1)).alias("similar_users"), F.sum("w").alias("weighted_score"), F.array_join(supporters, ",").alias("supporters"))
        .join(totals, "src")
        .withColumn("reason_score", F.col("similar_users") / F.col("total_similar"))
        .withColumn("weighted_score", F.round("weighted_score", 6))
    )
    ranked = top_n(scored, ["src"], [F.desc("reason_score"), F.desc("weighted_score"), F.asc("item")], top_n_items)
    return ranked.select(
        "src", "item", "similar_users", F.round("reason_score", 4).alias("reason_score"), "weighted_score", "supporters", "rnk"
    )


def reason_text(category: str, users: Column, share: Column, item: Column) -> Column:
    return F.format_string(REASONS[category], users.cast("int"), F.bround(share * 100).cast("int"), item)


def readiness(persons: DataFrame, similar: DataFrame) -> DataFrame:
    """Whether each person can be recommended to: it exists and has similar persons."""
    have = similar.groupBy(F.col("src").alias("uuid")).agg(row_count("n"))
    return persons.select("uuid").join(have, "uuid", "full_outer").join(
        persons.select("uuid", F.lit(True).alias("person_exists")), "uuid", "left"
    ).select(
        "uuid", F.coalesce("person_exists", F.lit(False)).alias("person_exists"),
        (F.coalesce("n", F.lit(0)) > 0).alias("has_similarity"),
    )


# --- communities and influence ------------------------------------------------------------------


def community_summary(members: DataFrame, hobbies: DataFrame, persons: DataFrame, min_size: int) -> DataFrame:
    """Size, representative, five top hobbies and three top provinces of each community."""
    sizes = members.groupBy("community_id").agg(row_count("size"), F.min("uuid").alias("representative")).where(
        F.col("size") >= min_size
    )
    tops = {}
    for out, values, n in (
        ("top_hobbies", members.join(hobbies.withColumnRenamed("item", "name"), "uuid"), 5),
        ("top_provinces", members.join(persons.select("uuid", F.col("province").alias("name")), "uuid"), 3),
    ):
        counts = values.groupBy("community_id", "name").agg(row_count())
        best = top_n(counts, ["community_id"], [F.desc("cnt"), F.asc("name")], n)
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("rnk", "name"))), lambda x: x["name"])
        tops[out] = best.groupBy("community_id").agg(ordered.alias(out))
    return sizes.join(tops["top_hobbies"], "community_id", "left").join(tops["top_provinces"], "community_id", "left")


def community_label(hobbies: Column, provinces: Column) -> Column:
    empty = F.array().cast("array<string>")
    h, p = F.coalesce(hobbies, empty), F.coalesce(provinces, empty)
    text = F.concat_ws(
        " ", F.nullif(F.array_join(F.slice(p, 1, 2), "/"), F.lit("")), F.nullif(F.array_join(F.slice(h, 1, 3), " + "), F.lit(""))
    )
    return F.when(text == "", "미분류 커뮤니티").otherwise(text)


def top_influence(scores: DataFrame, metric: str, limit: int, community: DataFrame | None = None, community_id=None) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    rows = scores.where(F.col(metric).isNotNull())
    if community is not None:
        rows = rows.join(community.where(F.col("community_id") == community_id), "uuid", "left_semi")
    return top_n_global(rows.select("uuid", F.col(metric).cast("double").alias("score")), [F.desc("score"), F.asc("uuid")], limit)


def status_now(log: DataFrame) -> DataFrame:
    """Current row per job of an append-only run log (key, status, run_id, at)."""
    latest = F.max_by(F.struct("status", "run_id"), F.struct("at", "run_id"))
    return log.groupBy("key").agg(
        latest.alias("now"),
        F.max(F.when(F.col("status") == "success", F.col("at"))).alias("last_success_at"),
        F.max(F.when(F.col("status") == "failed", F.col("at"))).alias("last_failure_at"),
    ).select("key", "now.status", "now.run_id", "last_success_at", "last_failure_at")


def with_staleness(status: DataFrame) -> DataFrame:
    return status.withColumn("stale", F.coalesce(F.col("status") != "success", F.lit(False)))
