"""Ranking metrics in long form (metric, k, value), segment gaps, deltas and promotion gates.

Lists are (uuid, item, rnk), truths are (uuid, item); every metric is one aggregation per person
followed by one over persons.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgraph.functions.columns import row_count
from popgraph.session import cut_lineage

KS = (5, 10, 20)


def _ideal(n: Column, k: int) -> Column:
    gains = F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int"))
    return F.aggregate(gains, F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))


def per_person(truth: DataFrame, recs: DataFrame, ks=KS) -> DataFrame:
    """uuid and for each k its recall, hit rate and ndcg."""
    truth = truth.select("uuid", "item").distinct()
    sizes = truth.groupBy("uuid").agg(row_count("n"))
    hits = recs.where(F.col("rnk") <= max(ks)).select("uuid", "item", "rnk").join(truth, ["uuid", "item"])
    sums = hits.groupBy("uuid").agg(
        *[F.count_if(F.col("rnk") <= k).alias(f"h{k}") for k in ks],
        *[F.sum(F.when(F.col("rnk") <= k, 1 / F.log2(F.col("rnk") + 1)).otherwise(0.0)).alias(f"d{k}") for k in ks],
    )
    rows = sizes.join(sums, "uuid", "left").fillna(0)
    out = []
    for k in ks:
        out += [
            (F.col(f"h{k}") / F.col("n")).alias(f"recall@{k}"),
            (F.col(f"h{k}") > 0).cast("double").alias(f"hit_rate@{k}"),
            (F.col(f"d{k}") / _ideal(F.col("n"), k)).alias(f"ndcg@{k}"),
        ]
    return rows.select("uuid", *out)


def truth_ranks(rows: DataFrame, truth: DataFrame, scores: list[Column], k: int) -> DataFrame:
    """(gid, uuid, item, rnk) of the truth's items among the first k of the person's rows, for every one of several scores.

    A position is one plus the number of the person's rows with a larger score, or the same and an earlier item; a row
    whose score is null is not in that list. Only rows that are in the truth need a position, so rows are not
    repeated and sorted per score: they are sorted once by item, and the comparisons are counted.
    """
    wanted = truth.select("uuid", "item").distinct().withColumn("__wanted", F.lit(True))
    mine = Window.partitionBy("uuid")
    placed = rows.join(wanted, ["uuid", "item"], "left").withColumn("__at", F.row_number().over(mine.orderBy("item")))
    hit = F.when(F.col("__wanted"), F.struct(F.col("__at").alias("at"), "item", F.array(*scores).alias("s")))
    held = placed.withColumn("__hits", F.collect_list(hit).over(mine)).where(F.size("__hits") > 0)
    met = held.withColumn("__hit", F.explode("__hits"))
    better = []
    for i, score in enumerate(scores):
        other = F.get("__hit.s", F.lit(i))
        before = (score > other) | ((score == other) & (F.col("__at") < F.col("__hit.at")))
        better.append(F.when(F.first(other).isNotNull(), F.count_if(before) + 1).cast("int"))
    ranked = met.groupBy("uuid", F.col("__hit.at").alias("__at")).agg(F.first("__hit.item").alias("item"), F.array(*better).alias("__ranks"))
    return ranked.select("uuid", "item", F.posexplode("__ranks").alias("gid", "rnk")).where(F.col("rnk") <= k).select("gid", "uuid", "item", "rnk")


def long_form(one_row: DataFrame) -> DataFrame:
    """Columns named metric@k of a one-row table as (metric, k, value)."""
    rows = one_row.unpivot([], one_row.columns, "name", "value")
    parts = F.split("name", "@")
    return rows.select(
        F.get(parts, F.lit(0)).alias("metric"), F.get(parts, F.lit(1)).cast("int").alias("k"),
        F.coalesce("value", F.lit(0.0)).alias("value"),
    )


def accuracy(truth: DataFrame, recs: DataFrame, ks=KS) -> DataFrame:
    rows = per_person(truth, recs, ks)
    return long_form(rows.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in rows.columns if c != "uuid"]))


def evaluated(truth: DataFrame, recs: DataFrame) -> DataFrame:
    return recs.join(truth.select("uuid").distinct(), "uuid", "left_semi")


def coverage(recs: DataFrame, n_items: int, ks=KS) -> DataFrame:
    """Share of the catalogue that is recommended; counted from the best rank of each item."""
    best = recs.groupBy("item").agg(F.min("rnk").alias("best"))
    return long_form(best.agg(*[
        (F.count_if(F.col("best") <= k) / F.lit(max(n_items, 1))).alias(f"catalog_coverage@{k}") for k in ks
    ]))


def novelty(recs: DataFrame, pop: DataFrame, ks=KS) -> DataFrame:
    """Mean over persons of the mean self-information of their items."""
    total = pop.agg(F.sum("pop")).first()[0] or 1
    info = -F.log2((F.coalesce("pop", F.lit(0)) + F.lit(1e-9)) / F.lit(total))
    rows = recs.join(pop.select("item", "pop"), "item", "left").withColumn("info", info)
    per = rows.groupBy("uuid").agg(*[F.avg(F.when(F.col("rnk") <= k, F.col("info"))).alias(f"novelty@{k}") for k in ks])
    return long_form(per.agg(*[F.avg(F.col(f"`novelty@{k}`")).alias(f"novelty@{k}") for k in ks]))


def category_diversity(recs: DataFrame, categories: DataFrame, ks=KS) -> DataFrame:
    """Share of item pairs of a list whose categories differ, mean over lists of two or more.

    Equal pairs follow from the category counts, so no pair is formed.
    """
    tagged = recs.join(categories.select("item", "category"), "item", "left").withColumn("category", F.coalesce("category", F.lit("")))
    per_cat = tagged.groupBy("uuid", "category").agg(*[F.count_if(F.col("rnk") <= k).alias(f"c{k}") for k in ks])
    per = per_cat.groupBy("uuid").agg(
        *[F.sum(f"c{k}").alias(f"n{k}") for k in ks],
        *[F.sum(F.col(f"c{k}") * (F.col(f"c{k}") - 1)).alias(f"s{k}") for k in ks],
    )
    share = {k: F.when(F.col(f"n{k}") >= 2, 1 - F.col(f"s{k}") / (F.col(f"n{k}") * (F.col(f"n{k}") - 1))) for k in ks}
    return long_form(per.agg(*[F.avg(share[k]).alias(f"intra_list_diversity@{k}") for k in ks]))


def oracle_recall(truth: DataFrame, pool: DataFrame, ks=KS) -> DataFrame:
    """Best recall any order of the pool could reach."""
    truth = truth.select("uuid", "item").distinct()
    sizes = truth.groupBy("uuid").agg(row_count("n"))
    found = truth.join(pool.select("uuid", "item"), ["uuid", "item"], "left_semi").groupBy("uuid").agg(row_count("f"))
    rows = sizes.join(found, "uuid", "left").fillna(0)
    return long_form(rows.agg(*[F.avg(F.least(F.col("f"), F.lit(k)) / F.col("n")).alias(f"oracle_recall@{k}") for k in ks]))


def candidate_recall(truth: DataFrame, pool: DataFrame, size: int) -> DataFrame:
    return accuracy(truth, pool, (size,)).where(F.col("metric") == "recall").withColumn("metric", F.lit("candidate_recall"))


def by_segment(truth: DataFrame, recs: DataFrame, contexts: DataFrame, k: int, fields=("age_group", "sex")) -> DataFrame:
    """Recall per segment value and, in rows named "gap", the largest minus the smallest."""
    rows = per_person(truth, recs, (k,)).select("uuid", F.col(f"`recall@{k}`").alias("recall"))
    ctx = contexts.select(F.col("person_uuid").alias("uuid"), *fields)
    tagged = rows.join(ctx, "uuid", "left").select(
        "recall",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit("unknown")).alias("value")) for f in fields])).alias("s"),
    )
    per = tagged.groupBy("s.field", "s.value").agg(F.avg("recall").alias("recall"), row_count("persons"))
    gap = per.groupBy("field").agg(
        F.when(F.count(F.lit(1)) >= 2, F.max("recall") - F.min("recall")).otherwise(0.0).alias("recall"), F.sum("persons").alias("persons")
    )
    return per.unionByName(gap.select("field", F.lit("gap").alias("value"), "recall", "persons"))


def summary(truth: DataFrame, recs: DataFrame, n_items: int, pop: DataFrame, categories: DataFrame | None = None, pool: DataFrame | None = None, ks=KS) -> DataFrame:
    """All ranking metrics of one set of lists."""
    if truth.isEmpty():
        names = [f"{m}@{k}" for m in ("recall", "ndcg", "hit_rate", "catalog_coverage", "novelty") for k in ks]
        return truth.sparkSession.createDataFrame([(n.split("@")[0], int(n.split("@")[1]), 0.0) for n in names], "metric string, k int, value double")
    # four aggregations read the lists; they are ranked once
    mine = cut_lineage(evaluated(truth, recs.where(F.col("rnk") <= max(ks)).select("uuid", "item", "rnk")))
    parts = [accuracy(truth, mine, ks), coverage(mine, n_items, ks), novelty(mine, pop, ks)]
    if categories is not None:
        parts.append(category_diversity(mine, categories, ks))
    if pool is not None:
        parts.append(oracle_recall(truth, pool, ks))
    return reduce(DataFrame.unionByName, parts)


def cold_start(known: DataFrame, truth: DataFrame, most: int = 1) -> DataFrame:
    """Truth rows of persons with at most `most` known items."""
    sizes = known.groupBy("uuid").agg(row_count("n")).where(F.col("n") > most)
    return truth.join(sizes.select("uuid"), "uuid", "left_anti")


def deltas(base: DataFrame, other: DataFrame) -> DataFrame:
    """Metrics of two variants side by side with their difference."""
    b = base.select("metric", "k", F.col("value").alias("base"))
    o = other.select("metric", "k", F.col("value").alias("other"))
    return b.join(o, ["metric", "k"]).withColumn("delta", F.col("other") - F.col("base"))


# --- promotion gates ------------------------------------------------------------------------------

# Fixed thresholds of the promotion gates.
RECALL_GATE, NDCG_GATE, NDCG_GATE_MMR = -0.002, 0.005, -0.002
PHASE5_RECALL, PHASE5_NDCG = -0.002, -0.002
PROBE_RECALL, PROBE_NDCG = -0.010, -0.010
PROBE_REVIEW_RECALL, PROBE_REVIEW_NDCG = -0.005, -0.005
DRIFT_TOLERANCE = 1e-6
DIVERSITY_GAINS = {"catalog_coverage": 0.025, "novelty": 0.10, "intra_list_diversity": 0.02}


def _delta_columns(delta: DataFrame, k: int = 10) -> DataFrame:
    at = F.col("k") == k
    names = ["recall", "ndcg", *DIVERSITY_GAINS]
    return delta.agg(*[
        F.coalesce(F.max(F.when(at & (F.col("metric") == m), F.col("delta"))), F.lit(0.0)).alias(m) for m in names
    ])


def _status(split: Column, ok: Column, validation: str, test: str) -> Column:
    return F.when((split == "validation") & ok, validation).when((split == "test") & ok, test).otherwise("blocked")


def gate_either(delta: DataFrame, split: str) -> DataFrame:
    """First gate: recall or ndcg is not below the baseline."""
    rows = _delta_columns(delta)
    ok = (F.col("recall") >= 0) | (F.col("ndcg") >= 0)
    return rows.select(F.lit(split).alias("split"), ok.alias("passed"), _status(F.lit(split), ok, "eligible_for_test", "promoted").alias("status"))


def gate_both(delta: DataFrame, split: str, use_mmr: bool = False) -> DataFrame:
    """Second gate: recall and ndcg above fixed thresholds."""
    rows = _delta_columns(delta)
    threshold = NDCG_GATE_MMR if split == "validation" and use_mmr else NDCG_GATE
    r, n = F.col("recall") >= RECALL_GATE, F.col("ndcg") >= threshold
    return rows.select(
        F.lit(split).alias("split"), r.alias("recall_passed"), n.alias("ndcg_passed"),
        _status(F.lit(split), r & n, "eligible_for_test", "promoted").alias("status"),
    )


def _gains() -> Column:
    return sum(((F.col(m) >= g).cast("int") for m, g in DIVERSITY_GAINS.items()), F.lit(0))


def gate_diversity(delta: DataFrame, split: str, candidate_drift: float, fallbacks: int) -> DataFrame:
    """Third gate: accuracy kept, two of three diversity gains, stable candidates, no fallback."""
    rows = _delta_columns(delta).withColumn("gains", _gains())
    ok = (
        (F.col("recall") >= PHASE5_RECALL) & (F.col("ndcg") >= PHASE5_NDCG) & (F.col("gains") >= 2)
        & F.lit(abs(candidate_drift) <= DRIFT_TOLERANCE) & F.lit(fallbacks == 0)
    )
    return rows.select(F.lit(split).alias("split"), "gains", ok.alias("passed"), _status(F.lit(split), ok, "eligible_for_test", "promoted").alias("status"))


def gate_probe(delta: DataFrame, split: str, candidate_drift: float, fallbacks: int) -> DataFrame:
    """Probe gate: looser accuracy, with a review trigger."""
    rows = _delta_columns(delta).withColumn("gains", _gains())
    ok = (
        (F.col("recall") >= PROBE_RECALL) & (F.col("ndcg") >= PROBE_NDCG) & (F.col("gains") >= 2)
        & F.lit(abs(candidate_drift) <= DRIFT_TOLERANCE) & F.lit(fallbacks == 0)
    )
    review = (F.col("recall") < PROBE_REVIEW_RECALL) | (F.col("ndcg") < PROBE_REVIEW_NDCG)
    needs = "requires_additional_review" if split == "validation" else "needs_review"
    status = F.when(~ok | F.lit(split not in ("validation", "test")), "blocked").when(review, needs).otherwise("passed")
    return rows.select(F.lit(split).alias("split"), "gains", ok.alias("passed"), review.alias("review"), status.alias("status"))


# --- recommendation-quality audit -----------------------------------------------------------------


def frequencies(recs: DataFrame) -> DataFrame:
    return recs.groupBy("item").agg(row_count("freq"))


def entropy(counts: DataFrame, column: str) -> DataFrame:
    """Shannon entropy in bits of a table of counts: log2(total) - sum(c * log2(c)) / total."""
    c = F.col(column)
    sums = counts.where(c > 0).agg(F.sum(c).alias("t"), F.sum(c * F.log2(c)).alias("s"))
    return sums.select(F.coalesce(F.log2("t") - F.col("s") / F.col("t"), F.lit(0.0)).alias("entropy"))


def audit_popularity(freq: DataFrame, ranks: DataFrame) -> DataFrame:
    """Frequency-weighted popularity rank and share of recommendations beyond ranks 50 and 100."""
    fallback = ranks.count() + 1
    rank = F.coalesce("pop_rank", F.lit(fallback))
    rows = freq.join(ranks.select("item", "pop_rank"), "item", "left").withColumn("r", rank)
    total = F.sum("freq")
    return rows.agg(
        (F.sum(F.col("r") * F.col("freq")) / total).alias("avg_popularity_rank"),
        (F.sum(F.when(F.col("r") > 50, F.col("freq")).otherwise(0)) / total).alias("share_beyond_50"),
        (F.sum(F.when(F.col("r") > 100, F.col("freq")).otherwise(0)) / total).alias("share_beyond_100"),
    )


def audit_novelty(freq: DataFrame, pop: DataFrame) -> DataFrame:
    """Frequency-weighted self-information; an item without train popularity counts 0."""
    total = pop.agg(F.sum("pop")).first()[0] or 1
    info = F.when(F.col("pop") > 0, -F.log2(F.col("pop") / F.lit(total))).otherwise(0.0)
    rows = freq.join(pop.select("item", "pop"), "item", "left")
    return rows.agg((F.sum(info * F.col("freq")) / F.sum("freq")).alias("avg_novelty"))


def category_counts(freq: DataFrame, categories: DataFrame) -> DataFrame:
    named = freq.join(categories.select("item", "category"), "item", "left").withColumn(
        "category", F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown"))
    )
    return named.groupBy("category").agg(F.sum("freq").alias("freq"))


def categories_per_person(recs: DataFrame, categories: DataFrame) -> DataFrame:
    named = recs.join(categories.select("item", "category"), "item", "left").withColumn(
        "category", F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown"))
    )
    per = named.select("uuid", "category").distinct().groupBy("uuid").agg(row_count("n"))
    return per.agg(F.avg("n").alias("avg_categories"))
