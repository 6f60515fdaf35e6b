"""Item names: normalisation, canonical names, rare-item policy, vocabulary report and coverage gate."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popgraph.functions.columns import row_count, top_n
from popgraph.functions.skew import dense_index
from popgraph.session import cut_lineage


@F.pandas_udf(T.StringType())
def _nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def squash(c: Column) -> Column:
    """Trimmed, lower case, inner white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def normalize_names(names: DataFrame, column: str, out: str) -> DataFrame:
    """Normal form of each distinct name; compatibility composition runs once per name, not per row."""
    return names.select(column).distinct().select(column, squash(_nfkc(F.col(column))).alias(out))


def rule_match(name: Column, rules: list[dict], field: str = "canonical") -> Column:
    """Value of the first rule with an include keyword and no exclude keyword in the name, else null.

    Rules are parameters, so they become one CASE expression and need no join.
    """
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        include = F.lit(False)
        for k in rule["include"]:
            include = include | name.contains(k)
        for k in rule.get("exclude", []):
            include = include & ~name.contains(k)
        out = F.when(include, F.lit(rule[field])).otherwise(out)
    return out


def canonical_names(vocabulary: DataFrame, aliases: DataFrame, rules: list[dict]) -> DataFrame:
    """(raw, name, canonical, how): alias first, then the first matching rule, then the name itself."""
    joined = vocabulary.join(aliases.select(F.col("raw").alias("name"), F.col("canonical").alias("alias")), "name", "left")
    rule = rule_match(F.col("name"), rules)
    return joined.select(
        "raw", "name", F.coalesce("alias", rule, "name").alias("canonical"),
        F.when(F.col("alias").isNotNull(), "alias").when(rule.isNotNull(), "rule").otherwise("name").alias("how"),
    )


def prepare_edges(raw: DataFrame, aliases: DataFrame, rules: list[dict]) -> DataFrame:
    """raw(uuid, raw) with canonical item per row; blank names are dropped."""
    vocabulary = normalize_names(raw, "raw", "name").where(F.col("name") != "")
    names = canonical_names(vocabulary, aliases, rules).where(F.col("canonical") != "")
    return raw.join(names.select("raw", F.col("canonical").alias("item")), "raw").select("uuid", "raw", "item")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select("uuid", "item").distinct().groupBy("item").agg(row_count("degree"))


def apply_rare_policy(edges: DataFrame, min_degree: int, policy: str) -> DataFrame:
    """Distinct (uuid, item, rare); `drop` removes rare items, `keep_with_fallback` marks them."""
    if min_degree < 1:
        raise ValueError("min_item_degree must be at least 1")
    if policy not in ("drop", "keep_with_fallback"):
        raise ValueError("rare_item_policy must be 'drop' or 'keep_with_fallback'")
    pairs = edges.select("uuid", "item").distinct()
    marked = degrees(edges).select("item", (F.col("degree") < min_degree).alias("rare"))
    out = pairs.join(marked, "item").select("uuid", "item", "rare")
    return out.where(~F.col("rare")) if policy == "drop" else out


def observed_variants(edges: DataFrame, n: int = 5) -> DataFrame:
    """First raw spellings of each canonical item; rows are cut per item before they are listed."""
    distinct = edges.select("item", F.trim("raw").alias("raw")).where(F.col("raw") != "").distinct()
    top = top_n(distinct, ["item"], [F.asc("raw")], n)
    names = F.transform(F.sort_array(F.collect_list(F.struct("rnk", "raw"))), lambda x: x["raw"])
    return top.groupBy("item").agg(names.alias("variants"))


def retained_subset(table: DataFrame, retained: DataFrame) -> DataFrame:
    return table.join(retained.select("item").distinct(), "item", "left_semi")


def vocabulary_report(raw: DataFrame, edges: DataFrame, retained: DataFrame, min_degree: int) -> DataFrame:
    """Counters and ratios of the raw, canonical and retained vocabulary as (metric, value)."""
    def counters(prefix, df, name, persons=True):
        per = df.groupBy(name).agg(row_count("n"))
        agg = per.agg(
            F.sum("n").cast("double").alias(f"{prefix}_edges"), F.count(F.lit(1)).cast("double").alias(f"{prefix}_hobbies"),
            F.count_if(F.col("n") == 1).cast("double").alias(f"{prefix}_singleton_hobbies"),
        )
        agg = agg.withColumn(
            f"{prefix}_singleton_ratio",
            F.when(F.col(f"{prefix}_hobbies") > 0, F.col(f"{prefix}_singleton_hobbies") / F.col(f"{prefix}_hobbies")).otherwise(0.0),
        )
        rows = agg.unpivot([], agg.columns, "metric", "value")
        if persons:
            who = df.agg(F.count_distinct("uuid").cast("double").alias("value")).select(F.lit(f"{prefix}_persons").alias("metric"), "value")
            rows = rows.unionByName(who)
        return rows

    canonical = edges.select("uuid", "item").distinct()
    kept = retained.select("uuid", "item")
    rare = degrees(edges).where(F.col("degree") < min_degree).agg(
        F.count(F.lit(1)).cast("double").alias("rare_items_count"),
        F.coalesce(F.sum("degree"), F.lit(0)).cast("double").alias("rare_edges_count"),
    )
    base = counters("raw", raw, "raw", persons=False).unionByName(counters("canonical", canonical, "item"))
    base = base.unionByName(counters("retained", kept, "item")).unionByName(rare.unpivot([], rare.columns, "metric", "value"))
    pick = {m: F.max(F.when(F.col("metric") == m, F.col("value"))) for m in (
        "canonical_edges", "retained_edges", "canonical_hobbies", "retained_hobbies", "canonical_persons", "retained_persons")}
    dropped = base.agg(*[
        (pick[f"canonical_{x}"] - pick[f"retained_{x}"]).alias(f"dropped_{x}") for x in ("edges", "hobbies", "persons")
    ])
    return base.unionByName(dropped.unpivot([], dropped.columns, "metric", "value"))


def coverage_gate(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Current report against a baseline: more edges and persons, fewer items and singletons."""
    rules = {"canonical_edges": "ge", "canonical_persons": "ge", "canonical_hobbies": "lt", "canonical_singleton_ratio": "lt"}
    b = baseline.where(F.col("metric").isin(*rules)).select("metric", F.col("value").alias("baseline"))
    joined = b.join(current.select("metric", F.col("value").alias("current")), "metric")
    at_least = F.col("metric").isin(*[m for m, r in rules.items() if r == "ge"])
    return joined.select(
        "metric", F.round("baseline", 6).alias("baseline"), F.round("current", 6).alias("current"),
        F.when(at_least, F.col("current") >= F.col("baseline")).otherwise(F.col("current") < F.col("baseline")).alias("passed"),
    )


# --- taxonomy mining ------------------------------------------------------------------------------

# Fixed generic words: a cluster whose suffix contains one of them as a word must be split by hand.
GENERIC_TOKENS = ["시청", "감상", "모임", "투어", "체험", "활동", "방문", "관람", "참여", "참가"]
# Fixed patterns whose names are listed as ambiguous.
AMBIGUOUS_PATTERNS = ["시청", "감상", "모임", "투어", "체험"]
# Fixed words and endings that mark a suffix as a specific activity.
ACTIVITY_WORDS = [
    "걷기", "공부", "구경", "노래방", "독서", "드라이브", "등산", "러닝", "볼링", "산책", "수영", "여행", "요가", "운동",
    "자전거", "조깅", "캠핑",
]
ACTIVITY_ENDINGS = ["하기", "타기", "걷기", "뛰기", "읽기", "보기", "듣기", "치기", "배우기", "만들기"]
# Fixed generic one-word suffixes and word groups that are never approved automatically.
GENERIC_SUFFIXES = [
    "가꾸기", "감상", "경기", "관리", "관람", "구경", "기르기", "꾸미기", "노력", "모임", "먹기", "방문", "시청", "연습", "즐기기",
    "참가", "참여", "체험", "투어", "활동", "키우기",
]
GENERIC_GROUPS = ["및 분석", "한 잔"]


def merge_review(rules: list[dict], review_rules: list[dict], aliases: DataFrame, review_aliases: DataFrame) -> tuple[list[dict], DataFrame]:
    """Approved clusters after the existing rules; a reviewed alias replaces an existing one."""
    merged = aliases.select("raw", F.col("canonical").alias("old")).join(
        review_aliases.select("raw", F.col("canonical").alias("new")), "raw", "full_outer"
    )
    return rules + review_rules, merged.select("raw", F.coalesce("new", "old").alias("canonical"))


def canonical_groups(edges: DataFrame) -> DataFrame:
    """Per canonical item: number of raw spellings and of supporting edges."""
    return edges.groupBy("item").agg(F.count_distinct("raw").alias("members"), row_count("support_edges"))


def suffix_candidates(name: Column) -> Column:
    """The last two words and the last word of a name, when shorter than the name itself."""
    words = F.split(name, " ")
    n = F.size(words)
    one = F.when(n >= 2, F.element_at(words, -1))
    two = F.when(n >= 3, F.array_join(F.slice(words, -2, 2), " "))
    return F.filter(F.array_compact(F.array(two, one)), lambda x: F.length(x) > 1)


def mine_suffixes(vocabulary: DataFrame, min_support: int) -> DataFrame:
    """(name, suffix): every name goes to its longest suffix; suffixes short of support are pruned until none is.

    Only (suffix, count) decides a round, so a suffix that a third of all names share is counted with
    partial sums and never gathered.
    """
    pairs = cut_lineage(vocabulary.select("name", F.explode(suffix_candidates(F.col("name"))).alias("suffix")).distinct())
    alive = cut_lineage(pairs.groupBy("suffix").agg(row_count("n")).where(F.col("n") >= max(min_support, 1)).select("suffix"))
    count = alive.count()
    while True:  # suffixes only ever leave
        live = pairs.join(alive, "suffix", "left_semi")
        best = F.min(F.struct(
            (-F.size(F.split("suffix", " "))).alias("words"), (-F.length("suffix")).alias("chars"), "suffix"
        )).alias("b")
        assigned = cut_lineage(live.groupBy("name").agg(best).select("name", F.col("b.suffix").alias("suffix")))
        alive = cut_lineage(assigned.groupBy("suffix").agg(row_count("n")).where(F.col("n") >= max(min_support, 1)).select("suffix"))
        now = alive.count()
        if now == count:
            return assigned.join(alive, "suffix", "left_semi")
        count = now


def suffix_clusters(assigned: DataFrame, support: DataFrame) -> DataFrame:
    """Members and supporting edges per suffix."""
    return assigned.join(support, "name").groupBy("suffix").agg(row_count("members"), F.sum("support_edges").alias("support_edges"))


def cluster_status(
    clusters: DataFrame, generic: list[str] = GENERIC_TOKENS, activities: list[str] = ACTIVITY_WORDS,
    endings: list[str] = ACTIVITY_ENDINGS,
) -> DataFrame:
    """Confidence by size and by how specific the suffix is; a suffix with a generic word must be split."""
    words = F.split("suffix", " ")
    last = F.element_at(words, -1)
    is_generic = F.arrays_overlap(words, F.array(*[F.lit(g) for g in generic]))
    active = F.col("suffix").isin(activities) | last.isin(activities)
    for e in endings:
        active = active | last.endswith(e)
    return clusters.withColumn(
        "confidence",
        F.when((F.col("members") >= 20) & active & ~is_generic, "high").when(F.col("members") >= 10, "medium").otherwise("low"),
    ).withColumn("status", F.when(is_generic, "split_required").otherwise("pending_review"))


def all_clusters(mined: DataFrame, assigned: DataFrame, support: DataFrame) -> DataFrame:
    """Mined clusters first, then every name no cluster absorbed, with sequential ids by support."""
    single = support.join(assigned.select("name"), "name", "left_anti").select(
        F.col("name").alias("suffix"), F.lit(1).cast("long").alias("members"), "support_edges",
        F.lit("low").alias("confidence"), F.lit("pending_review").alias("status"), F.lit("singleton").alias("source"),
    )
    both = mined.withColumn("source", F.lit("mined_suffix")).unionByName(single)
    keyed = both.withColumn("__kind", (F.col("source") == "singleton").cast("int")).withColumn("__neg", -F.col("support_edges"))
    return dense_index(keyed, ["__kind", "__neg", "suffix"], "pos").withColumn(
        "cluster_id", F.format_string("cluster_%04d", F.col("pos") + 1)
    ).drop("__kind", "__neg", "pos")


def mining_summary(support: DataFrame, clusters: DataFrame, assigned: DataFrame) -> DataFrame:
    """Counters of a mining run as (metric, value)."""
    raw = support.agg(
        F.count(F.lit(1)).cast("double").alias("raw_hobbies"),
        F.round(F.avg((F.col("support_edges") == 1).cast("double")), 6).alias("raw_singleton_ratio"),
    )
    mined = clusters.agg(
        F.count(F.lit(1)).cast("double").alias("candidate_clusters"),
        *[F.count_if(F.col("confidence") == c).cast("double").alias(f"{c}_confidence_clusters") for c in ("high", "medium", "low")],
        F.count_if(F.col("source") == "mined_suffix").cast("double").alias("mined_cluster_count"),
    )
    covered = assigned.agg(F.count(F.lit(1)).cast("double").alias("mined_hobby_coverage"))
    out = None
    for part in (raw, mined, covered):
        rows = part.unpivot([], part.columns, "metric", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def ambiguous_groups(support: DataFrame, patterns: list[str], n: int = 10) -> DataFrame:
    """Best supported names that contain each generic pattern."""
    hits = F.array_compact(F.array(*[F.when(F.col("name").contains(p), F.lit(p)) for p in patterns]))
    rows = support.select(F.explode(hits).alias("pattern"), "name", "support_edges")
    return top_n(rows, ["pattern"], [F.desc("support_edges"), F.asc("name")], n)


def auto_approve(
    clusters: DataFrame, min_members: int, generic: list[str] = GENERIC_SUFFIXES, groups: list[str] = GENERIC_GROUPS
) -> DataFrame:
    """Decision per cluster: approved, split required or left for review."""
    too_generic = F.col("suffix").isin(generic)
    for g in groups:
        too_generic = too_generic | F.col("suffix").contains(g)
    fits = (F.col("source") == "mined_suffix") & (F.col("members") >= min_members) & F.col("confidence").isin("high", "medium")
    return clusters.withColumn(
        "decision",
        F.when(F.col("status") == "split_required", "split_required")
        .when(fits & (F.col("status") == "pending_review") & ~too_generic, "approved").otherwise("pending"),
    )


def strict_rewrite(names: DataFrame, dropped: list[str], redirect: dict[str, str]) -> DataFrame:
    """Canonical names without the dropped ones, redirected names replaced."""
    target = F.col("canonical")
    for old, new in redirect.items():
        target = F.when(F.col("canonical") == old, F.lit(new)).otherwise(target)
    return names.where(~F.col("canonical").isin(dropped)).withColumn("canonical", target)


def category_share(edges: DataFrame, categories: Column) -> DataFrame:
    """Share of each person's items that fall in its largest category."""
    per = edges.select("uuid", categories.alias("category")).groupBy("uuid", "category").agg(row_count())
    return per.groupBy("uuid").agg((F.max("cnt") / F.sum("cnt")).alias("top_share"))


def overmerge_report(edges: DataFrame, categories: Column) -> DataFrame:
    """Category concentration per person and the rare items by category, as (metric, value)."""
    shares = category_share(edges, categories).agg(
        F.avg("top_share").alias("mean"), F.stddev_pop("top_share").alias("std"), F.min("top_share").alias("min"), F.max("top_share").alias("max")
    )
    freq = edges.groupBy("item").agg(row_count())
    rare = freq.where(F.col("cnt") <= percentile_value(freq, "cnt", 0.2))
    by_cat = rare.select(categories.alias("category")).groupBy("category").agg(row_count())
    total = F.sum("cnt").over(Window.partitionBy())
    cats = by_cat.select(F.concat(F.lit("rare:"), "category").alias("metric"), F.col("cnt").cast("double").alias("value"), (F.col("cnt") / total).alias("share"))
    alert = cats.agg(F.coalesce(F.max((F.col("share") > 0.5).cast("double")), F.lit(0.0)).alias("value")).select(F.lit("alert").alias("metric"), "value")
    return shares.unpivot([], shares.columns, "metric", "value").unionByName(cats.select("metric", "value")).unionByName(alert)


def percentile_value(df: DataFrame, column: str, q: float):
    """Value at index floor(q * n) of the sorted column, from counts per distinct value."""
    sizes = df.groupBy(column).agg(row_count("__n"))
    upto = F.sum("__n").over(Window.orderBy(column))
    total = F.sum("__n").over(Window.partitionBy())
    found = sizes.withColumn("__upto", upto).withColumn("__total", total).where(
        F.col("__upto") > F.floor(F.lit(q) * F.col("__total"))
    )
    return found.agg(F.min(column)).first()[0]
