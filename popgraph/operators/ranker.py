"""Learned ranker on pyspark.ml: negative sampling, datasets, training, ranking, searches over parameters."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popgraph.functions.columns import row_count, shuffle_key
from popgraph.functions.skew import join_measured
from popgraph.operators import features, metrics
from popgraph.operators.interactions import dense_ids
from popgraph.session import cut_lineage

BASE_FEATURES = [
    "lightgcn_score", "cooccurrence_score", "segment_popularity_score", "known_hobby_compatibility", "age_group_fit",
    "occupation_fit", "region_fit", "popularity_prior", "mismatch_penalty", "popularity_penalty", "novelty_bonus",
    "category_diversity_reward", "is_cold_start",
]
SOURCE_FEATURES = ["source_is_popularity", "source_is_cooccurrence", "source_count"]
TEXT_FEATURES = ["text_embedding_similarity"]
CATEGORICAL = ["is_cold_start", "source_is_popularity", "source_is_cooccurrence"]


def feature_columns(source: bool = False, text: bool = False) -> list[str]:
    return BASE_FEATURES + (SOURCE_FEATURES if source else []) + (TEXT_FEATURES if text else [])


def categorical_columns(columns: list[str]) -> list[str]:
    return [c for c in CATEGORICAL if c in columns]


def sample_negatives(
    positives: DataFrame, pool: DataFrame, known: DataFrame, items: DataFrame,
    neg_ratio: int = 4, hard_ratio: float = 0.8, seed: int = 42,
) -> DataFrame:
    """(uuid, item, kind): hard negatives from the pool, easy ones from outside it."""
    ranked = negative_ranks(positives, pool, known, items, [(neg_ratio, hard_ratio)], seed)
    return drawn(ranked, neg_ratio, hard_ratio).select("uuid", "item", "kind")


def _shares(neg_ratio: int, hard_ratio: float) -> tuple[Column, Column]:
    """Negatives of a person with n positives, and how many of them shall be hard."""
    total = F.col("n") * neg_ratio
    return total, F.floor(total * F.lit(hard_ratio))


def _most(values: list[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def negative_ranks(
    positives: DataFrame, pool: DataFrame, known: DataFrame, items: DataFrame, settings: list[tuple[int, float]], seed: int = 42
) -> DataFrame:
    """(uuid, item, kind, r, n, n_free): the negatives of every setting (ratio, hardness), r their place in the person's draw.

    A setting draws the first ones of either kind (`drawn`), so all settings share one ranking. Easy items are drawn by
    stepping through the catalogue from a hashed start with a step coprime to its size. A person with m excluded items
    looks at m + needed positions only: at most m of them are excluded, so enough remain and no person meets the whole
    catalogue.
    """
    pos = positives.select("uuid", "item").distinct()
    want = pos.groupBy("uuid").agg(row_count("n"))
    people = want.select("uuid")
    taken = pos.unionByName(known.select("uuid", "item").join(people, "uuid", "left_semi"))
    in_pool = pool.select("uuid", "item").join(people, "uuid", "left_semi")
    marked = taken.withColumn("taken", F.col("item").isNotNull()).unionByName(in_pool.withColumn("taken", F.lit(False)))
    order = Window.partitionBy("uuid").orderBy("taken", shuffle_key("uuid", "item", seed=seed), "item")
    excluded = cut_lineage(
        marked.groupBy("uuid", "item").agg(F.max("taken").alias("taken")).withColumn("r", F.row_number().over(order))
    )
    sizes = excluded.groupBy("uuid").agg(row_count("m"), F.count_if(~F.col("taken")).alias("n_free"))
    hard = excluded.where(~F.col("taken")).select("uuid", "item", "r").join(want.join(sizes.drop("m"), "uuid"), "uuid")
    hard = hard.where(F.col("r") <= _most([_shares(*s)[1] for s in settings])).withColumn("kind", F.lit("hard"))
    ids = cut_lineage(dense_ids(items, "item", "item_id"))
    n_items = ids.count()
    step = next(s for s in range(max(2, int(n_items * 0.618)), 2 * n_items + 3) if math.gcd(s, n_items) == 1)
    start = F.pmod(F.conv(F.substring(shuffle_key("uuid", seed=seed), 1, 12), 16, 10).cast("long"), F.lit(n_items))
    lacking = _most([total - F.least(n_hard, F.col("n_free")) for total, n_hard in (_shares(*s) for s in settings)])
    need = want.join(sizes, "uuid", "left").fillna(0).withColumn("need", lacking)
    looks = need.where(F.col("need") > 0).withColumn("start", start).withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("m") + F.col("need"), F.lit(n_items).cast("long")) - 1))
    ).withColumn("item_id", F.pmod(F.col("start") + F.col("j") * step, F.lit(n_items)))
    named = join_measured(looks.select("uuid", "n", "n_free", "need", "j", "item_id"), ids, "item_id", "uuid")
    free = named.join(excluded.select("uuid", "item"), ["uuid", "item"], "left_anti")
    easy = free.withColumn("r", F.row_number().over(Window.partitionBy("uuid").orderBy("j"))).where(F.col("r") <= F.col("need"))
    columns = ["uuid", "item", "kind", "r", "n", "n_free"]
    return hard.select(columns).unionByName(easy.withColumn("kind", F.lit("easy")).select(columns))


def drawn(rows: DataFrame, neg_ratio: int, hard_ratio: float) -> DataFrame:
    """The rows of one setting; rows of another kind than hard and easy belong to every setting."""
    total, n_hard = _shares(neg_ratio, hard_ratio)
    most = F.when(F.col("kind") == "hard", n_hard).when(F.col("kind") == "easy", total - F.least(n_hard, F.col("n_free")))
    return rows.where(most.isNull() | (F.col("r") <= most))


def dataset(
    positives: DataFrame, pool: DataFrame, known: DataFrame, items: DataFrame, contexts: DataFrame, profile: DataFrame,
    neg_ratio: int = 4, hard_ratio: float = 0.8, seed: int = 42, source: bool = False, text: bool = False,
) -> DataFrame:
    """Labelled feature rows; persons without context are left out."""
    every = datasets(positives, pool, known, items, contexts, profile, [(neg_ratio, hard_ratio)], seed, source, text)
    return one_dataset(every, neg_ratio, hard_ratio)


RANKED = ["kind", "r", "n", "n_free"]


def datasets(
    positives: DataFrame, pool: DataFrame, known: DataFrame, items: DataFrame, contexts: DataFrame, profile: DataFrame,
    settings: list[tuple[int, float]], seed: int = 42, source: bool = False, text: bool = False,
) -> DataFrame:
    """The rows of several settings (ratio, hardness) with their features, each built once; `one_dataset` takes one's."""
    negatives = negative_ranks(positives, pool, known, items, settings, seed)
    none = [F.lit("positive").alias("kind"), *[F.lit(None).cast("long").alias(c) for c in RANKED[1:]]]
    labelled = positives.select("uuid", "item").distinct().select("uuid", "item", *none, F.lit(1.0).alias("label")).unionByName(
        negatives.withColumn("label", F.lit(0.0))
    )
    rows = cut_lineage(labelled.join(pool.select("uuid", "item", "source_scores"), ["uuid", "item"], "left"))
    built = features.build(rows, contexts, known, profile, keep=["label", *RANKED]).where(F.col("has_context"))
    return built.select("uuid", "item", "label", *RANKED, *feature_columns(source, text))


def one_dataset(every: DataFrame, neg_ratio: int, hard_ratio: float) -> DataFrame:
    return drawn(every, neg_ratio, hard_ratio).drop(*RANKED)


def group_sizes(data: DataFrame) -> DataFrame:
    return data.groupBy("uuid").agg(row_count("rows"), F.sum("label").cast("long").alias("positives"))


def person_fold(data: DataFrame, share: float = 0.2, seed: int = 42):
    """Column that puts a person's rows together into the validation part."""
    bucket = F.conv(F.substring(shuffle_key("uuid", seed=seed), 1, 8), 16, 10).cast("long") % 1000
    return data.withColumn("is_validation", bucket < int(share * 1000))


# Tree parameters used where the caller gives none.
DEFAULTS = {"maxDepth": 4, "maxIter": 20, "stepSize": 0.1, "minInstancesPerNode": 5, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}


def fit(data: DataFrame, columns: list[str], params: dict | None = None, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees with early stopping on the validation persons."""
    p = {**DEFAULTS, **(params or {})}
    folded = data if "is_validation" in data.columns else person_fold(data)
    trees = GBTClassifier(
        labelCol="label", featuresCol="features", validationIndicatorCol="is_validation", seed=seed, validationTol=0.001, **p
    )
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), trees]).fit(folded)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(uuid, item, score): probability of the positive class."""
    out = model.transform(rows)
    return out.withColumn("score", F.round(F.get(vector_to_array("probability"), F.lit(1)), 9)).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def auc(model: PipelineModel, data: DataFrame) -> float:
    return BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC").evaluate(model.transform(data))


def rank(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Ranked lists; persons without context keep their stage-1 score."""
    scored = predict(model, rows).withColumn("score", F.when(F.col("has_context"), F.col("score")).otherwise(features.stage1_score()))
    w = Window.partitionBy("uuid").orderBy(F.desc("score"), F.asc("item"))
    return scored.withColumn("rnk", F.row_number().over(w)).select("uuid", "item", "score", "rnk")


def importance(model: PipelineModel, columns: list[str]) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, values)], "feature string, importance double")


def factors(train: DataFrame, rank_dim: int = 64, iterations: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Person and item vectors from implicit-feedback factorisation, keyed by uuid and item."""
    people = cut_lineage(dense_ids(train, "uuid", "pid"))
    items = cut_lineage(dense_ids(train, "item", "iid"))
    rows = join_measured(train.join(people, "uuid"), items, "item", "uuid").select(
        F.col("pid").cast("int").alias("pid"), F.col("iid").cast("int").alias("iid"), F.lit(1.0).alias("r")
    )
    model = ALS(
        userCol="pid", itemCol="iid", ratingCol="r", implicitPrefs=True, rank=rank_dim, maxIter=iterations, seed=seed, nonnegative=False
    ).fit(rows)
    p = model.userFactors.select(F.col("id").alias("pid"), F.col("features").alias("embedding")).join(people, "pid")
    i = model.itemFactors.select(F.col("id").alias("iid"), F.col("features").alias("embedding")).join(items, "iid")
    return p.select("uuid", "embedding"), i.select("item", "embedding")


def bpr_loss(triples: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean of -ln sigmoid(positive - negative) over triples (uuid, item, negative)."""
    s = scores.select("uuid", "item", "score")
    rows = triples.join(s.withColumnRenamed("score", "p"), ["uuid", "item"]).join(
        s.select("uuid", F.col("item").alias("negative"), F.col("score").alias("n")), ["uuid", "negative"]
    )
    return rows.agg(F.avg(F.log1p(F.exp(F.col("n") - F.col("p")))).alias("bpr_loss"), row_count("triples"))


def pairwise_loss(data: DataFrame, score: str = "score") -> DataFrame:
    """Logistic loss over a person's positive-negative pairs, mean per person, summed.

    A person's rows are its positives and the sampled negatives, a few per positive, so the pairs
    are few; positives meet negatives only.
    """
    pos = data.where(F.col("label") > 0).select("uuid", F.col(score).alias("p"))
    neg = data.where(F.col("label") <= 0).select("uuid", F.col(score).alias("n"))
    per = pos.join(neg, "uuid").groupBy("uuid").agg(F.avg(F.log1p(F.exp(F.col("n") - F.col("p")))).alias("loss"))
    return per.agg(F.sum("loss").alias("loss"), row_count("persons"))


def recall_of(model: PipelineModel, rows: DataFrame, truth: DataFrame, k: int = 10) -> float:
    found = metrics.accuracy(truth, rank(model, rows), (k,)).where(F.col("metric") == "recall")
    return found.first()["value"]


# Values tried per tree parameter in the regularisation search.
SEARCH_GRID = {
    "maxDepth": [3, 4, 5],
    "minInstancesPerNode": [5, 20, 50],
    "featureSubsetStrategy": ["all", "0.8", "0.6"],
    "subsamplingRate": [1.0, 0.8],
    "stepSize": [0.05, 0.1],
    "maxIter": [10, 20],
    "maxBins": [32, 64],
}


def coordinate_search(data, columns, rows, truth, grid=None, start=None, rounds: int = 2, min_gain: float = 1e-6) -> DataFrame:
    """One parameter at a time; a value stays only when validation recall@10 rises."""
    data, rows = cut_lineage(data), cut_lineage(rows)
    best = {**DEFAULTS, **(start or {})}
    best_recall = recall_of(fit(data, columns, best), rows, truth)
    log = [(0, "start", "", best_recall, True)]
    for r in range(1, rounds + 1):
        moved = False
        for name, values in (grid or SEARCH_GRID).items():
            for v in values:
                if best.get(name) == v:
                    continue
                recall = recall_of(fit(data, columns, {**best, name: v}), rows, truth)
                better = recall > best_recall + min_gain
                log.append((r, name, str(v), recall, better))
                if better:
                    best, best_recall, moved = {**best, name: v}, recall, True
        if not moved:
            break
    return data.sparkSession.createDataFrame(log, "round int, parameter string, value string, recall double, kept boolean")


def negative_search(make_data, columns, rows, truth, ratios=(1, 2, 4, 8), hardness=(0.5, 0.8, 1.0), params=None) -> DataFrame:
    """Best negative ratio first, then best hardness at that ratio, by validation recall@10.

    Only the truth's persons are ranked: recall reads no other list.
    """
    rows = cut_lineage(metrics.evaluated(truth, rows))
    log, known = [], {}

    def run(phase, ratio, hard):
        if (ratio, hard) not in known:  # both phases have the best ratio at 0.8
            known[ratio, hard] = recall_of(fit(cut_lineage(make_data(ratio, hard)), columns, params), rows, truth)
        log.append((phase, int(ratio), float(hard), known[ratio, hard]))
        return known[ratio, hard]

    best = max(ratios, key=lambda r: run("ratio", r, 0.8))
    for h in hardness:
        run("hardness", best, h)
    return rows.sparkSession.createDataFrame(log, "phase string, neg_ratio int, hard_ratio double, recall double")
