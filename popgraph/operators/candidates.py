"""Stage-1 candidate providers: (uuid, item, provider, raw_score), known items excluded, k per person.

Item-item providers share one plan: a person's known rows are shuffled once by person and meet the
item weights by broadcast (their size is counted first). The weight table also holds a marked (i, i)
row per item, so the aggregation that sums the scores recognises known items by itself; no anti-join
and no further shuffle is needed before the per-person top-k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popgraph.functions.columns import row_count, top_n
from popgraph.functions.skew import by_key, join_measured
from popgraph.operators import metrics
from popgraph.operators.interactions import popularity, popularity_ranks

SEGMENT_FIELDS = ["age_group", "occupation", "province", "district", "family_type", "housing_type", "education_level"]
GROUPS_PER_TASK = 500_000
PROVIDERS = ["popularity", "cooccurrence", "segment_popularity", "bm25", "idf_cooccurrence", "pop_capped", "jaccard", "pmi", "embedding"]


def _check(k: int) -> None:
    if k <= 0:
        raise ValueError("top_k must be positive")


def _tag(df: DataFrame, provider: str, k: int) -> DataFrame:
    top = top_n(df, ["uuid"], [F.desc("raw_score"), F.asc("item")], k, rank="src_rank")
    return top.select("uuid", "item", F.lit(provider).alias("provider"), F.col("raw_score").cast("double").alias("raw_score"))


# --- item-item weights ----------------------------------------------------------------------------


def _with_degrees(cooc: DataFrame, pop: DataFrame) -> DataFrame:
    src = pop.select(F.col("item").alias("src"), F.col("pop").alias("d_src"))
    dst = pop.select(F.col("item").alias("dst"), F.col("pop").alias("d_dst"))
    return cooc.join(src, "src").join(dst, "dst")


def item_weights(kind: str, cooc: DataFrame, pop: DataFrame, train: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(src, dst, w) of one weighting; c = common persons, d = persons of an item, n = persons."""
    if kind == "cooccurrence":
        return cooc.select("src", "dst", F.col("c").cast("double").alias("w"))
    rows = _with_degrees(cooc, pop)
    c, ds, dd = F.col("c"), F.col("d_src"), F.col("d_dst")
    n = F.lit(train.select("uuid").distinct().count()) if kind in ("bm25", "idf_cooccurrence", "pmi") else None
    if kind == "bm25":
        avg_degree = F.lit(pop.agg(F.avg("pop")).first()[0])
        idf = F.ln((n - ds + 0.5) / (ds + 0.5) + 1.0)
        w = idf * (c * (k1 + 1)) / (c + k1 * (1 - b + b * (dd / avg_degree)))
    elif kind == "idf_cooccurrence":
        w = c * F.ln((n + 1) / (1 + dd))
    elif kind == "pop_capped":
        w = c / F.ln(1.0 + dd)
    elif kind == "jaccard":
        w = c / (ds + dd - c)
    elif kind == "pmi":
        w = F.greatest(F.lit(0.0), F.ln((c / n) / ((ds / n) * (dd / n))))
    else:
        raise ValueError(f"unknown weighting {kind}")
    return rows.select("src", "dst", w.cast("double").alias("w"))


def item_item(known: DataFrame, weights: DataFrame, items: DataFrame, provider: str, k: int) -> DataFrame:
    _check(k)
    self_rows = items.select(F.col("item").alias("src"), F.col("item").alias("dst"), F.lit(0.0).alias("w"))
    table = weights.unionByName(self_rows).withColumnRenamed("src", "item")
    rows = join_measured(by_key(known.select("uuid", "item"), "uuid"), table, "item", "uuid")
    # scores that differ only by summation order count as equal, so ties go by item
    scored = rows.groupBy("uuid", "dst").agg(
        F.round(F.sum("w"), 9).alias("raw_score"), F.max(F.col("item") == F.col("dst")).alias("is_known")
    )
    return _tag(scored.where(~F.col("is_known")).withColumnRenamed("dst", "item"), provider, k)


# --- popularity -----------------------------------------------------------------------------------


def popularity_candidates(persons: DataFrame, known: DataFrame, pop: DataFrame, k: int, provider: str = "popularity") -> DataFrame:
    """The k most popular items each person lacks.

    With m known items the answer lies in the first k+m ranks: list those ranks, remove the known
    ones and keep k, so each person costs k+m numbers instead of one row per catalogue item.
    """
    _check(k)
    ranks = popularity_ranks(pop)
    mine = join_measured(known.select("uuid", "item"), ranks.select("item", "pop_rank"), "item", "uuid")
    taken = mine.groupBy("uuid").agg(F.collect_set("pop_rank").alias("taken"))
    empty = F.array().cast("array<int>")
    listed = persons.select("uuid").distinct().join(taken, "uuid", "left")
    taken_c = F.coalesce("taken", empty)
    upto = F.least(F.lit(k) + F.size(taken_c), F.lit(pop.count())).cast("int")
    free = F.slice(F.array_except(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), taken_c), 1, k)
    rows = listed.select("uuid", F.explode(free).alias("pop_rank"))
    out = join_measured(rows, ranks, "pop_rank", "uuid")
    return out.select("uuid", "item", F.lit(provider).alias("provider"), F.col("pop").cast("double").alias("raw_score"))


def with_backfill(cooc_candidates: DataFrame, pop_candidates: DataFrame, k: int) -> DataFrame:
    """Ranked co-occurrence candidates, filled up with popular items to k: (uuid, item, rnk)."""
    both = cooc_candidates.select("uuid", "item", F.lit(0).alias("prio"), "raw_score").unionByName(
        pop_candidates.select("uuid", "item", F.lit(1).alias("prio"), "raw_score")
    )
    once = both.groupBy("uuid", "item").agg(F.min(F.struct("prio", (-F.col("raw_score")).alias("neg"))).alias("b"))
    return top_n(once, ["uuid"], [F.asc("b.prio"), F.asc("b.neg"), F.asc("item")], k).select("uuid", "item", "rnk")


# --- segment popularity ---------------------------------------------------------------------------


def segment_candidates(contexts: DataFrame, known: DataFrame, histogram: DataFrame, pop: DataFrame, k: int) -> DataFrame:
    """Sum of the person's value shares per item plus a small popularity term.

    Each person asks for its seven values, for "any item" (the popularity term) and for its known
    items, which come back marked. One shuffle by person, one measured broadcast, one aggregation; the number of tasks grows
    with persons times items, so that a task's groups do not.
    """
    _check(k)
    shares = histogram.where(F.col("field").isin(SEGMENT_FIELDS)).select(
        F.concat_ws("=", "field", "value").alias("ask"), "item", F.col("share").alias("w"), F.lit(False).alias("known")
    )
    every = pop.select(F.lit("any").alias("ask"), "item", (F.col("pop") * 1e-6).alias("w"), F.lit(False).alias("known"))
    marks = pop.select(F.concat(F.lit("known="), "item").alias("ask"), "item", F.lit(0.0).alias("w"), F.lit(True).alias("known"))
    table = shares.unionByName(every).unionByName(marks)
    asks = F.array(F.lit("any"), *[F.concat(F.lit(f"{f}="), F.trim(F.col(f))) for f in SEGMENT_FIELDS])
    people = contexts.select(F.col("person_uuid").alias("uuid"), F.explode(asks).alias("ask"))
    have = known.select("uuid", F.concat(F.lit("known="), "item").alias("ask"))
    have = have.join(contexts.select(F.col("person_uuid").alias("uuid")), "uuid", "left_semi")
    # a person meets every item, so the groups a task sums are bounded by its persons times the items
    tasks = math.ceil(contexts.count() * pop.count() / GROUPS_PER_TASK)
    rows = join_measured(by_key(people.unionByName(have), "uuid", least=tasks), table, "ask", "uuid")
    scored = rows.groupBy("uuid", "item").agg(F.sum("w").alias("raw_score"), F.max("known").alias("is_known"))
    rounded = scored.where(~F.col("is_known")).withColumn("raw_score", F.round("raw_score", 9))
    return _tag(rounded.where(F.col("raw_score") > 0), "segment_popularity", k)


# --- embedding dot product ------------------------------------------------------------------------

MAX_ITEMS = 200_000


def embedding_candidates(user_vectors: DataFrame, item_vectors: DataFrame, known: DataFrame, k: int, provider: str = "embedding") -> DataFrame:
    """k items with the largest dot product that the person lacks.

    Each task scores its persons against the item matrix (size checked) and returns k plus the number
    of known items per person, enough to hold the answer once the known ones are removed.
    """
    _check(k)
    rows = item_vectors.select("item", "embedding").orderBy("item").limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"item catalogue exceeds {MAX_ITEMS} rows")
    names = np.array([r["item"] for r in rows])
    matrix = np.array([r["embedding"] for r in rows], dtype="float64")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            s = np.array(pdf["embedding"].tolist(), dtype="float64") @ matrix.T
            order = np.argsort(-s, axis=1, kind="stable")
            for u, m, o, row in zip(pdf["uuid"], pdf["m"], order, s):
                take = o[: k + int(m)]
                yield pd.DataFrame({"uuid": u, "item": names[take], "raw_score": row[take]})

    sizes = known.groupBy("uuid").agg(row_count("m"))
    asked = user_vectors.select("uuid", "embedding").join(sizes, "uuid", "left").select("uuid", "embedding", F.coalesce("m", F.lit(0)).alias("m"))
    hits = asked.mapInPandas(score, "uuid string, item string, raw_score double")
    return _tag(hits.join(known.select("uuid", "item"), ["uuid", "item"], "left_anti"), provider, k)


def cold_requests(requests: DataFrame, persons: DataFrame, pop: DataFrame, k: int) -> DataFrame:
    """Popular items for requested persons that are unknown to the data."""
    unknown = requests.join(persons.select("uuid"), "uuid", "left_anti")
    none = unknown.sparkSession.createDataFrame([], "uuid string, item string")
    return popularity_candidates(unknown, none, pop, k, "popularity_fallback")


# --- normalisation and merging --------------------------------------------------------------------


def normalize_scores(candidates: DataFrame, method: str = "rank_percentile") -> DataFrame:
    """Adds score in [0, 1] and rnk per person and provider; equal raw scores go by item."""
    if method not in ("rank_percentile", "min_max"):
        raise ValueError("score normalization method must be 'rank_percentile' or 'min_max'")
    group = Window.partitionBy("uuid", "provider")
    ranked = candidates.withColumn("rnk", F.row_number().over(group.orderBy(F.desc("raw_score"), F.asc("item"))))
    if method == "rank_percentile":
        n = F.count(F.lit(1)).over(group)
        score = F.when(n == 1, 1.0).otherwise(1 - (F.col("rnk") - 1) / (n - 1))
    else:
        lo, hi = F.min("raw_score").over(group), F.max("raw_score").over(group)
        score = F.when(hi == lo, 1.0).otherwise((F.col("raw_score") - lo) / (hi - lo))
    return ranked.withColumn("score", score)


def merge(normalized: DataFrame, k: int, order: list[str]) -> DataFrame:
    """One row per person and item: best of the providers in `order`, all their scores; k items per person.

    One maximum per provider keeps the aggregation in fixed-width columns (hash aggregation in generated
    code); the score maps are put together afterwards.
    """
    _check(k)
    of = {p: F.col("provider") == p for p in order}
    grouped = normalized.where(F.col("provider").isin(order)).groupBy("uuid", "item").agg(
        *[F.max(F.when(c, F.col("score"))).alias(f"s_{p}") for p, c in of.items()],
        *[F.max(F.when(c, F.col("raw_score"))).alias(f"r_{p}") for p, c in of.items()],
    )
    best = F.greatest(*[F.col(f"s_{p}") for p in order]) if len(order) > 1 else F.col(f"s_{order[0]}")
    winner = F.lit(len(order))
    for i, p in reversed(list(enumerate(order))):
        winner = F.when(F.col(f"s_{p}") == F.col("score"), i).otherwise(winner)
    rows = grouped.withColumn("score", best).withColumn("ord", winner)
    top = top_n(rows, ["uuid"], [F.desc("score"), F.asc("ord"), F.asc("item")], k)
    names = F.array(*[F.lit(p) for p in order])

    def scores(prefix):
        pairs = F.create_map(*[x for p in order for x in (F.lit(p), F.col(f"{prefix}_{p}"))])
        return F.map_filter(pairs, lambda _, v: v.isNotNull())

    raw = F.get(F.array(*[F.col(f"r_{p}") for p in order]), F.col("ord"))
    return top.select(
        "uuid", "item", F.get(names, F.col("ord")).alias("provider"), "score", raw.alias("raw_score"),
        scores("s").alias("source_scores"), scores("r").alias("raw_scores"), "rnk",
    )


def ablation(normalized: DataFrame, truth: DataFrame, combos: list[list[str]], k: int) -> DataFrame:
    """(combo, recall): recall at k of the lists that `merge` makes of each set of providers, from one grouping for all sets.

    Rank percentiles fall strictly with the rank, so a provider's entries behind its first k are never among a set's
    first k by that provider's score: k entries of the same set are better.
    """
    _check(k)
    names = list(dict.fromkeys(p for c in combos for p in c))
    near = normalized.where((F.col("rnk") <= k) & F.col("provider").isin(names))
    wide = near.groupBy("uuid", "item").agg(*[F.max(F.when(F.col("provider") == p, F.col("score"))).alias(f"s_{p}") for p in names])
    scores = []
    for combo in combos:
        cols = [F.col(f"s_{p}") for p in combo]
        best = F.greatest(*cols) if len(cols) > 1 else cols[0]
        order = F.lit(-len(combo))
        for i, c in reversed(list(enumerate(cols))):
            order = F.when(c == best, -i).otherwise(order)
        scores.append(F.when(best.isNotNull(), F.struct(best.alias("score"), order.alias("order"))))
    ranks = metrics.truth_ranks(wide, truth, scores, k)
    truth = truth.select("uuid", "item").distinct()
    sizes = truth.groupBy("uuid").agg(row_count("n"))
    hits = ranks.groupBy("gid", "uuid").agg(row_count("h")).join(sizes, "uuid").groupBy("gid").agg(F.sum(F.col("h") / F.col("n")).alias("r"))
    total = sizes.agg(row_count("n")).first()["n"]
    every = truth.sparkSession.createDataFrame([(i, "+".join(c)) for i, c in enumerate(combos)], "gid int, combo string")
    recall = F.coalesce(F.col("r") / F.lit(max(total, 1)), F.lit(0.0))
    return every.join(hits, "gid", "left").select("combo", recall.alias("recall"))


def contribution(normalized: DataFrame, pool: DataFrame) -> DataFrame:
    """Per provider: candidates offered and candidates whose best source it was."""
    offered = normalized.groupBy("provider").agg(row_count("raw_candidates"))
    chosen = pool.groupBy("provider").agg(row_count("selected"))
    return offered.join(chosen, "provider", "left").select(
        "provider", "raw_candidates", F.coalesce("selected", F.lit(0)).alias("selected")
    )


def fallback_usage(persons: DataFrame, known: DataFrame, normalized: DataFrame) -> DataFrame:
    """Per person: candidates per provider, known items and why a fallback was used, if any."""
    counts = normalized.groupBy("uuid").agg(
        F.count_if(F.col("provider") == "popularity").alias("n_popularity"),
        F.count_if(F.col("provider") == "cooccurrence").alias("n_cooccurrence"),
    )
    sizes = known.groupBy("uuid").agg(row_count("n_known"))
    rows = persons.select("uuid").distinct().join(counts, "uuid", "left").join(sizes, "uuid", "left").fillna(0)
    return rows.select(
        "uuid", "n_known", "n_popularity", "n_cooccurrence", (F.col("n_known") <= 1).alias("cold_start"),
        F.when(F.col("n_popularity") + F.col("n_cooccurrence") == 0, "no_candidates")
        .when(F.col("n_cooccurrence") == 0, "popularity_only").otherwise("none").alias("primary_reason"),
    )
