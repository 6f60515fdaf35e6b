"""One segment specification behind search, comparison, cohort and target-group filters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed synonyms of the sex filter.
SEX_SYNONYMS = {"여성": "여자", "남성": "남자"}


@dataclass(frozen=True)
class Segment:
    """Conditions that must all hold. `match` says how text values compare: in, equals or contains."""

    province: list[str] | None = None
    district: list[str] | None = None
    age_min: int | None = None
    age_max: int | None = None
    age_group: list[str] | None = None
    sex: str | None = None
    occupation: list[str] | None = None
    education: list[str] | None = None
    hobby: list[str] | None = None
    skill: list[str] | None = None
    keyword: str | None = None
    match: str = field(default="in")

    def given(self) -> dict[str, object]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "match" and getattr(self, f.name) is not None}


def parse_csv(value: str | None) -> list[str] | None:
    items = [v.strip() for v in (value or "").split(",") if v.strip()]
    return items or None


def parse_age_groups(value: str | None) -> list[str] | None:
    """"10,20대,30" -> ["10대", "20대", "30대"]."""
    items = parse_csv(value)
    return [v if v.endswith("대") else f"{v}대" for v in items] if items else None


def normalize_sex(value: str | None) -> str | None:
    value = (value or "").strip() or None
    return SEX_SYNONYMS.get(value, value) if value else None


def compact_term(term: str) -> str:
    return re.sub(r"[\s\-_/.]", "", term.strip().lower())


def occupation_matches(c: Column, terms: list[str]) -> Column:
    """A name matches a term as written, or with separators removed on both sides."""
    name = F.lower(c)
    compact = F.regexp_replace(name, r"[ \-_/]", "")
    tests = [name.contains(t) | compact.contains(compact_term(t)) for t in terms if t]
    return reduce(or_, tests) if tests else F.lit(False)


def _text_test(c: Column, values: list[str], match: str) -> Column:
    if match == "contains":
        return reduce(or_, [c.contains(v) for v in values])
    return c.isin(list(values))


def person_predicate(s: Segment) -> Column | None:
    """The part of a segment that person columns decide; it reaches the scan as a pushed filter."""
    tests: list[Column] = []
    if s.province is not None:
        tests.append(F.col("province").isin(list(s.province)))
    if s.district is not None:
        tests.append(F.col("district_key").isin(list(s.district)) | F.col("district").isin(list(s.district)))
    if s.age_min is not None:
        tests.append(F.col("age") >= s.age_min)
    if s.age_max is not None:
        tests.append(F.col("age") <= s.age_max)
    if s.age_group is not None:
        tests.append(F.col("age_group").isin(list(s.age_group)))
    if s.sex is not None:
        tests.append(F.col("sex") == normalize_sex(s.sex))
    if s.occupation is not None:
        if s.match == "in":
            tests.append(occupation_matches(F.col("occupation"), s.occupation))
        else:
            tests.append(_text_test(F.col("occupation"), s.occupation, s.match))
    if s.education is not None:
        tests.append(F.col("education_level").isin(list(s.education)))
    return reduce(and_, tests) if tests else None


def select_segment(
    persons: DataFrame,
    s: Segment,
    hobbies: DataFrame | None = None,
    skills: DataFrame | None = None,
    texts: DataFrame | None = None,
    uuids: DataFrame | None = None,
) -> DataFrame:
    """Persons of the segment, each once: columns filter, traits and uuid lists are semi joins."""
    predicate = person_predicate(s)
    out = persons if predicate is None else persons.where(predicate)
    if s.hobby is not None:
        out = out.join(hobbies.where(_text_test(F.col("item"), s.hobby, s.match)).select("uuid"), "uuid", "left_semi")
    if s.skill is not None:
        out = out.join(skills.where(_text_test(F.col("skill"), s.skill, s.match)).select("uuid"), "uuid", "left_semi")
    if s.keyword is not None:
        out = out.join(texts.where(F.col("persona").contains(s.keyword)).select("uuid"), "uuid", "left_semi")
    if uuids is not None:
        out = out.join(uuids.select("uuid"), "uuid", "left_semi")
    return out


def require_filters(s: Segment) -> Segment:
    if not s.given():
        raise ValueError("at least one filter is required")
    return s
