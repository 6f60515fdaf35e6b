"""Additive contributions of the linear score and reason texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popgraph.operators.features import SUBTRACTED, check_weights

# Fixed sentence per feature.
REASONS = {
    "lightgcn_score": "그래프 기반 추천 점수가 높습니다",
    "cooccurrence_score": "비슷한 사용자들이 함께 선호하는 취미입니다",
    "segment_popularity_score": "당신의 세그먼트에서 인기가 높습니다",
    "known_hobby_compatibility": "기존 취미와 자주 함께 등장합니다",
    "age_group_fit": "당신의 연령대에서 인기가 높습니다",
    "occupation_fit": "당신의 직업군에서 선호도가 높습니다",
    "region_fit": "당신의 거주 지역에서 접근하기 좋습니다",
    "popularity_prior": "전체적으로 인기 있는 취미입니다",
    "mismatch_penalty": "인구통계학적 적합도가 낮습니다",
    "popularity_penalty": "인기가 너무 높아 다양성을 위해 조정되었습니다",
    "novelty_bonus": "흔하지 않은 새로운 취미입니다",
    "category_diversity_reward": "카테고리 다양성을 위해 선택되었습니다",
    "is_cold_start": "취미 정보가 적은 사용자를 위한 추천입니다",
    "source_is_popularity": "인기도 기반 후보입니다",
    "source_is_cooccurrence": "공동선호 기반 후보입니다",
    "source_count": "여러 소스에서 추천된 후보입니다",
    "text_embedding_similarity": "페르소나 텍스트와 유사도가 높습니다",
}
NO_VALUES = "추천 이유를 생성할 수 없습니다."
NO_POSITIVE = "주요 추천 요인을 확인할 수 없습니다."


def contributions(weights: dict[str, float] | None = None) -> Column:
    """Array of (feature, contribution): weight times value, exact because the score is a sum."""
    parts = []
    for name, w in check_weights(weights or {}).items():
        if w:
            signed = -w if name in SUBTRACTED else w
            parts.append(F.struct(F.lit(name).alias("feature"), F.round(signed * F.col(name), 9).alias("contribution")))
    return F.array(*parts)


def reason(contribs: Column, top_k: int = 3) -> Column:
    """Sentences of the largest positive contributions, joined; two fixed fallbacks."""
    # NaN sorts above every number, so comparing with the largest double drops NaN and infinity
    finite = F.filter(contribs, lambda c: F.abs(c["contribution"]) <= 1.7e308)
    positive = F.filter(finite, lambda c: c["contribution"] > 0)
    ordered = F.array_sort(F.transform(positive, lambda c: F.struct((-c["contribution"]).alias("neg"), c["feature"].alias("feature"))))
    texts = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    named = F.transform(
        F.slice(ordered, 1, top_k),
        lambda c: F.coalesce(F.try_element_at(texts, c["feature"]), F.concat(c["feature"], F.lit(" 특성이 긍정적으로 작용했습니다"))),
    )
    return (
        F.when(F.size(finite) == 0, NO_VALUES).when(F.size(positive) == 0, NO_POSITIVE)
        .otherwise(F.concat(F.array_join(named, "; "), F.lit(".")))
    )


def validate(reasons: DataFrame) -> DataFrame:
    """One-row check of a batch (reason, finite): meaningful share, stray NaN or mask tokens."""
    real = (F.col("reason") != "") & ~F.col("reason").isin(NO_VALUES, NO_POSITIVE)
    agg = reasons.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(real).alias("meaningful"),
        F.coalesce(F.bool_or(F.col("reason").contains("NaN")), F.lit(False)).alias("has_nan"),
        F.coalesce(F.bool_or(F.col("reason").contains("[MASK]")), F.lit(False)).alias("has_mask"),
        F.coalesce(F.bool_and("finite"), F.lit(True)).alias("finite"),
    )
    rate = F.when(F.col("total") > 0, F.col("meaningful") / F.col("total")).otherwise(0.0)
    return agg.withColumn("meaningful_rate", F.round(rate, 6)).withColumn(
        "passed", (F.col("total") > 0) & (rate >= 0.9) & ~F.col("has_nan") & ~F.col("has_mask") & F.col("finite")
    )
