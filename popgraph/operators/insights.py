"""Profiles, career cohorts, lifestyle maps and target groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.functions.columns import ratio, row_count, top_n_global
from popgraph.operators.filters import Segment, select_segment
from popgraph.schema import PERSONA_TEXTS



def profile_rows(persons: DataFrame, hobbies: DataFrame, skills: DataFrame) -> DataFrame:
    """Profile of every person as (uuid, attribute, value): ten traits, each hobby, each skill.

    Lists stay rows, so a person with very many traits never becomes one oversized row.
    """
    traits = [
        "province", "district", "country", "occupation", "education_level", "bachelors_field", "marital_status",
        "military_status", "family_type", "housing_type",
    ]
    scalar = persons.select(
        "uuid", F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("value")) for c in traits])).alias("t")
    ).select("uuid", "t.*").where(F.col("value").isNotNull())
    known = persons.select("uuid")
    h = hobbies.join(known, "uuid", "left_semi").select("uuid", F.lit("hobby").alias("attribute"), F.col("item").alias("value"))
    s = skills.join(known, "uuid", "left_semi").select("uuid", F.lit("skill").alias("attribute"), F.col("skill").alias("value"))
    return scalar.unionByName(h.distinct()).unionByName(s.distinct())


def graph_stats(persons: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges of each person, of which hobbies and skills."""
    mine = edges.where(F.col("src_label") == "Person").groupBy(F.col("src").alias("uuid")).agg(
        F.count(F.lit(1)).alias("total_connections"),
        F.count_if(F.col("rel") == "ENJOYS_HOBBY").alias("hobby_count"),
        F.count_if(F.col("rel") == "HAS_SKILL").alias("skill_count"),
    )
    zero = F.lit(0).cast("long")
    return persons.select("uuid").join(mine, "uuid", "left").select(
        "uuid", *[F.coalesce(c, zero).alias(c) for c in ("total_connections", "hobby_count", "skill_count")]
    )


def one_line_summary(persons: DataFrame) -> DataFrame:
    return persons.select(
        "uuid",
        F.concat_ws(", ", "display_name", F.concat(F.col("age").cast("string"), F.lit("세")), "district", "occupation").alias("summary"),
    )


# --- career cohorts -----------------------------------------------------------------------------


def cohort(persons: DataFrame, occupation: str, province=None, age_group=None, sex=None) -> DataFrame:
    s = Segment(
        occupation=[occupation], province=[province] if province else None,
        age_group=[age_group] if age_group else None, sex=sex, match="contains",
    )
    return select_segment(persons, s)


def ranked_items(counts: DataFrame, top_k: int, matched: DataFrame) -> DataFrame:
    """Top names with their share of the matched persons; blank names are dropped."""
    if not 3 <= top_k <= 30:
        raise ValueError("top_k must be between 3 and 30")
    top = top_n_global(counts, [F.desc("cnt"), F.asc("name")], top_k)
    named = top.where(F.col("name").isNotNull() & (F.col("name") != ""))
    return named.select("name", "cnt", ratio(F.col("cnt"), F.lit(matched.count())).alias("ratio"))


def goal_counts(people: DataFrame, texts: DataFrame) -> DataFrame:
    terms = F.split(F.translate(F.col("career_goals"), ";|/\n", ",,,,"), ",")
    goals = texts.join(people.select("uuid"), "uuid", "left_semi").select(F.explode(terms).alias("goal"))
    return goals.select(F.trim("goal").alias("name")).where(F.length("name") >= 2).groupBy("name").agg(row_count())


def skill_counts(people: DataFrame, skills: DataFrame) -> DataFrame:
    mine = skills.join(people.select("uuid"), "uuid", "left_semi")
    return mine.groupBy(F.col("skill").alias("name")).agg(row_count())


def hobby_counts(people: DataFrame, hobbies: DataFrame) -> DataFrame:
    mine = hobbies.join(people.select("uuid"), "uuid", "left_semi")
    return mine.groupBy(F.col("item").alias("name")).agg(row_count())


def neighbour_occupations(people: DataFrame, persons: DataFrame, hobbies: DataFrame) -> DataFrame:
    """Persons of another occupation who share a hobby with the cohort, counted per occupation.

    Per hobby it is enough to know the lowest and highest cohort occupation: a holder counts when one
    of them differs from its own. No person pairs are formed, so a hobby of a third of all persons
    costs one row per holder.
    """
    cohort_hobbies = (
        hobbies.join(people.select("uuid", "occupation"), "uuid")
        .groupBy("item").agg(F.min("occupation").alias("lo"), F.max("occupation").alias("hi"))
    )
    holders = hobbies.join(cohort_hobbies, "item").join(persons.select("uuid", "occupation"), "uuid")
    other = (F.col("occupation") != F.col("lo")) | (F.col("occupation") != F.col("hi"))
    return (
        holders.where(other).select("uuid", "occupation").distinct().groupBy(F.col("occupation").alias("name")).agg(row_count())
    )


def segment_counts(people: DataFrame, compare_by: str) -> DataFrame:
    if compare_by not in ("age_group", "sex", "province"):
        raise ValueError("compare_by must be age_group, sex or province")
    return (
        people.where(F.col(compare_by).isNotNull() & (F.col(compare_by) != ""))
        .groupBy(F.col(compare_by).alias("name")).agg(row_count())
    )


# --- lifestyle map ------------------------------------------------------------------------------

# Fixed stop words of keyword discovery.
STOPWORDS = [
    "그리고", "하지만", "또한", "위해", "통해", "정도", "관심", "활동", "생활", "사람", "현재", "주로", "대한", "있음", "있다",
]
# Fixed token pattern of keyword discovery.
TOKEN = "[가-힣A-Za-z0-9]{2,}"


def lifestyle_source(persons, texts, source_field: str, target_field: str, keyword: str, s: Segment | None = None) -> DataFrame:
    """Persons of the segment whose source text has the keyword, with their target text."""
    for f in (source_field, target_field):
        if f not in PERSONA_TEXTS[:7]:
            raise ValueError(f"unknown text field {f}")
    if source_field == target_field:
        raise ValueError("source and target field must differ")
    found = texts.where(F.col(source_field).contains(keyword.strip())).select("uuid", F.col(target_field).alias("target"))
    if s is None or not s.given():
        return found
    return found.join(select_segment(persons, s).select("uuid"), "uuid", "left_semi")


def discover_keywords(source: DataFrame, top_k: int, min_count: int) -> DataFrame:
    tokens = source.select(F.explode(F.regexp_extract_all("target", F.lit(TOKEN), F.lit(0))).alias("kw"))
    counts = tokens.where(~F.lower("kw").isin(STOPWORDS)).groupBy("kw").agg(row_count())
    return top_n_global(counts, [F.desc("cnt"), F.asc("kw")], top_k).where(F.col("cnt") >= min_count).select("kw", "cnt")


def keyword_overlap(source: DataFrame, keywords: list[str]) -> DataFrame:
    """How many source persons' target texts contain each keyword; one pass with one counter per keyword."""
    tests = F.array(
        *[F.struct(F.lit(k).alias("kw"), F.coalesce(F.col("target").contains(k), F.lit(False)).alias("hit")) for k in keywords]
    )
    per_kw = source.select(F.explode(tests).alias("t")).groupBy("t.kw").agg(
        F.count_if(F.col("t.hit")).alias("overlap_count"), F.count(F.lit(1)).alias("support_count")
    )
    return per_kw.where(F.col("overlap_count") > 0).withColumn(
        "conditional_ratio", ratio(F.col("overlap_count"), F.col("support_count"))
    )


# --- target groups ------------------------------------------------------------------------------


def target_sample(people: DataFrame, texts: DataFrame, top_k: int) -> DataFrame:
    if not 1 <= top_k <= 10:
        raise ValueError("top_k must be between 1 and 10")
    first = top_n_global(people, [F.asc("age"), F.asc("uuid")], top_k, rank="pos")
    return first.join(texts.select("uuid", "persona"), "uuid", "left").select(
        "pos", "uuid", "display_name", "age", "sex", "province", "district", "occupation", "persona"
    )


def representative_traits(counts: DataFrame, n: int = 5) -> DataFrame:
    return top_n_global(counts, [F.desc("cnt"), F.asc("name")], n)


# Fixed sentences of the group profile.
PROFILE_START = "조건({condition})에 맞는 페르소나 집합의 대표 프로필입니다."
PROFILE_FACTS = ["핵심 성향", "주요 취미", "주요 스킬"]
PROFILE_EMPTY = "조건에 맞는 페르소나가 없어 대표 프로필을 생성할 수 없습니다."
PROFILE_PROMPT = (
    "조건 기반 대표 페르소나를 한국어 3~5문장으로 합성하세요. 필터={condition}. 대표 취미={hobbies}. "
    "대표 스킬={skills}. 근거 샘플={evidence}."
)


def representative_text(filters: dict[str, str], sample: DataFrame, hobbies: DataFrame, skills: DataFrame) -> DataFrame:
    """Deterministic group profile with evidence; the inputs are at most ten sample rows and five traits each."""
    people = sorted(sample.select("pos", "uuid", "persona").collect())
    names = [", ".join(r["name"] for r in sorted(t.select("rnk", "name").collect())) for t in (hobbies, skills)]
    condition = ", ".join(f"{k}={v}" for k, v in filters.items())
    evidence = ",".join(r["uuid"] for r in people)
    text = PROFILE_EMPTY
    if people:
        values = zip(PROFILE_FACTS, [people[0]["persona"], *names])
        text = " ".join([PROFILE_START.format(condition=condition), *(f"{label}: {value}" for label, value in values if value)])
    prompt = PROFILE_PROMPT.format(condition=condition, hobbies=names[0], skills=names[1], evidence=evidence)
    return sample.sparkSession.createDataFrame(
        [(len(people), evidence, text, prompt)],
        "sample_size long, evidence_uuids string, representative_text string, prompt string",
    )


def evaluate_cases(persons: DataFrame, cases: list[dict], hobbies: DataFrame, skills: DataFrame) -> DataFrame:
    """Golden cases against the data: each case is a segment with a minimum sample size, or must be rejected."""
    out = None
    for case in cases:
        s = Segment(**case["filters"], match="contains")
        if not s.given():
            row = persons.sparkSession.createDataFrame(
                [(case["id"], "rejected", 0, bool(case.get("reject")))], "id string, outcome string, matched long, passed boolean"
            )
        else:
            found = select_segment(persons, s, hobbies, skills).agg(F.count(F.lit(1)).alias("matched"))
            row = found.select(
                F.lit(case["id"]).alias("id"), F.lit("answered").alias("outcome"), "matched",
                (F.col("matched") >= case.get("min_sample_size", 0)).alias("passed"),
            )
        out = row if out is None else out.unionByName(row)
    return out
