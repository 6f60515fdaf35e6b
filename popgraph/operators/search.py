"""Faceted person search: total, sorting, paging and the semantic fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.operators.filters import Segment, select_segment

SORT_FIELDS = ("age", "display_name")
RESULT_COLUMNS = [
    "uuid", "display_name", "age", "sex", "persona", "province", "district", "occupation", "education_level",
]


def hits(persons, s: Segment, hobbies, skills, texts, uuids=None) -> DataFrame:
    found = select_segment(persons, s, hobbies, skills, texts, uuids)
    return found.join(texts.select("uuid", "persona"), "uuid", "left").select(*RESULT_COLUMNS)


def totals(found: DataFrame, page_size: int) -> DataFrame:
    if not 1 <= page_size <= 100:
        raise ValueError("page_size must be between 1 and 100")
    return found.agg(F.count(F.lit(1)).alias("total_count")).withColumn(
        "total_pages", F.ceil(F.col("total_count") / page_size)
    )


def page(found: DataFrame, sort_by: str = "age", order: str = "asc", number: int = 1, size: int = 20) -> DataFrame:
    """One page; an unknown sort falls back to age ascending, ties go by uuid."""
    column = sort_by if sort_by in SORT_FIELDS else "age"
    key = F.desc(column) if order.lower() == "desc" else F.asc(column)
    return found.orderBy(key, F.asc("uuid")).offset((number - 1) * size).limit(size)


def with_semantic_fallback(persons, s: Segment, hobbies, skills, texts, semantic_hits: DataFrame) -> DataFrame:
    """Exact hits; when there are none, persons whose vectors matched the search terms.

    The fallback keeps the other filters and drops occupation and keyword, which the vectors stand for.
    """
    exact = hits(persons, s, hobbies, skills, texts)
    terms = (s.occupation or []) + ([s.keyword] if s.keyword else [])
    if not terms or not exact.isEmpty():
        return exact
    relaxed = Segment(**{k: v for k, v in s.given().items() if k not in ("occupation", "keyword")}, match=s.match)
    return hits(persons, relaxed, hobbies, skills, texts, uuids=semantic_hits.select("uuid").distinct())
