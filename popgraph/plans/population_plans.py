"""Filters, distributions, search, profiles, cohorts and target groups (FL*, AG*, SR*, PR*, CT*, LM*, TP*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgraph.operators import insights, search, stats
from popgraph.operators.filters import Segment, select_segment
from popgraph.plans.registry import plan, view


def _seg(t, s, **kw):
    return select_segment(t.persons, s, t.hobbies, t.skills, t.texts, **kw)


def _filter(name, s, where, source="q_persons"):
    @plan(name, f"SELECT uuid FROM {source} WHERE {where}")
    def _(t):
        return _seg(t, s).select("uuid")


_H2, _S2 = ["Brand#1/ECONOMY", "Brand#7/PROMO"], ["s3", "s7"]
_HAS_H = "uuid IN (SELECT uuid FROM q_hob WHERE item IN ('Brand#1/ECONOMY', 'Brand#7/PROMO'))"
_HAS_S = "uuid IN (SELECT uuid FROM q_skl WHERE skill IN ('s3', 's7'))"
_filter("FL01_province", Segment(province=["ASIA", "EUROPE"]), "province IN ('ASIA', 'EUROPE')")
_filter("FL02_district", Segment(district=["ASIA-NATION_2", "NATION_7"]), "district_key = 'ASIA-NATION_2' OR district = 'NATION_7'")
_filter("FL03_age_range", Segment(age_min=30, age_max=45), "age BETWEEN 30 AND 45")
_filter("FL04_age_group", Segment(age_group=["30대", "50대"]), "age_group IN ('30대', '50대')")
_filter("FL05_sex", Segment(sex="여성"), "sex = '여자'")
_filter("FL06_occupation", Segment(occupation=["auto-MOBILE", "build"]),
        "lower(occupation) LIKE '%build%' OR regexp_replace(lower(occupation), '[ _/-]', '', 'g') LIKE '%automobile%'")
_filter("FL07_education", Segment(education=["e1", "e4"]), "education_level IN ('e1', 'e4')")
_filter("FL08_hobby", Segment(hobby=_H2), _HAS_H)
_filter("FL09_skill", Segment(skill=_S2), _HAS_S)
_filter("FL11_keyword", Segment(keyword="tion"), "uuid IN (SELECT uuid FROM q_texts WHERE contains(persona, 'tion'))")
_filter("FL13_segment_equality",
        Segment(province=["ASIA"], sex="남자", occupation=["BUILDING"], hobby=_H2, match="equals"),
        f"province = 'ASIA' AND sex = '남자' AND occupation = 'BUILDING' AND {_HAS_H}")
_filter("FL14_target_contains", Segment(age_group=["20대", "30대"], occupation=["MA"], hobby=["ECON"], skill=["s1"], match="contains"),
        """age_group IN ('20대', '30대') AND contains(occupation, 'MA')
  AND uuid IN (SELECT uuid FROM q_hob WHERE contains(item, 'ECON')) AND uuid IN (SELECT uuid FROM q_skl WHERE contains(skill, 's1'))""")
_filter("FL16_dimension_filters", Segment(province=["EUROPE"], age_group=["40대"], occupation=["HOUSE"], match="contains"),
        "province = 'EUROPE' AND age_group = '40대' AND contains(occupation, 'HOUSE')")


@plan("FL10_uuid_list", "SELECT uuid FROM q_persons WHERE uuid IN (SELECT uuid FROM q_vec WHERE label = 3)")
def _(t):
    return _seg(t, Segment(), uuids=t.vectors.where(F.col("label") == 3)).select("uuid")


@plan("FL15_not_null_dimension", "SELECT uuid, bachelors_field AS label FROM q_persons WHERE bachelors_field IS NOT NULL AND age_group IS NOT NULL AND sex IS NOT NULL")
def _(t):
    p = t.persons.where(F.col("age_group").isNotNull() & F.col("sex").isNotNull() & F.col("bachelors_field").isNotNull())
    return p.select("uuid", F.col("bachelors_field").alias("label"))


@plan("AG01_total", "SELECT count(*) AS total FROM q_persons")
def _(t):
    return stats.total(t.persons)


for _name, _col in [
    ("AG02_age_distribution", "age_group"), ("AG03_sex_distribution", "sex"), ("AG04_province_distribution", "province"),
    ("AG05_education_distribution", "education_level"), ("AG06_marital_distribution", "marital_status"),
]:
    def _dist(name=_name, col=_col):
        @plan(name, f"""SELECT {col} AS label, count(*) AS cnt, round(count(*) / (SELECT count(*) FROM q_persons), 4) AS ratio_of_total
FROM q_persons WHERE {col} IS NOT NULL GROUP BY {col}""")
        def _(t):
            return stats.distribution(t.persons, col)
    _dist()

_TOP = """SELECT {c} AS label, count(*) AS cnt, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rnk
FROM {src} GROUP BY {c} ORDER BY cnt DESC, {c} LIMIT {n}"""


@plan("AG07_top_occupations", _TOP.format(c="occupation", src="q_persons", n=20))
def _(t):
    return stats.top_values(stats.dimension_values("occupation", t.persons, t.hobbies, t.skills), 20)


@plan("AG08_top_hobbies", _TOP.format(c="item", src="q_hob", n=20))
def _(t):
    return stats.top_values(stats.dimension_values("hobby", t.persons, t.hobbies, t.skills), 20)


@plan("AG09_top_skills", _TOP.format(c="skill", src="q_skl", n=20))
def _(t):
    return stats.top_values(stats.dimension_values("skill", t.persons, t.hobbies, t.skills), 20)


_OVER = {"age": "age_group", "sex": "sex", "province": "province", "education": "education_level", "marital": "marital_status", "occupation": "occupation"}


@plan("AG10_overview", """
WITH c AS (SELECT 'total' AS section, 'all' AS label, count(*) AS cnt FROM q_persons
""" + "".join(f"UNION ALL SELECT '{s}', {c}, count(*) FROM q_persons WHERE {c} IS NOT NULL GROUP BY {c}\n" for s, c in _OVER.items()) + """
UNION ALL SELECT 'hobby', item, count(*) FROM q_hob GROUP BY item UNION ALL SELECT 'skill', skill, count(*) FROM q_skl GROUP BY skill),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY cnt DESC, label) AS rn FROM c)
SELECT section, label, cnt, round(cnt / (SELECT count(*) FROM q_persons), 4) AS ratio_of_total FROM r WHERE rn <= 20 OR section NOT IN ('occupation', 'hobby', 'skill')""")
def _(t):
    return stats.overview(t.persons, t.hobbies, t.skills)


_DIMS = {"age": "age_group", "sex": "sex", "province": "province", "district": "district", "occupation": "occupation",
         "education": "education_level", "marital": "marital_status", "military": "military_status",
         "family_type": "family_type", "housing": "housing_type"}


def _dim_source(dim, where):
    if dim == "hobby":
        return f"SELECT item AS label FROM q_hob WHERE uuid IN (SELECT uuid FROM q_persons WHERE {where})"
    if dim == "skill":
        return f"SELECT skill AS label FROM q_skl WHERE uuid IN (SELECT uuid FROM q_persons WHERE {where})"
    return f"SELECT {_DIMS[dim]} AS label FROM q_persons WHERE {_DIMS[dim]} IS NOT NULL AND {where}"


def _dim_sql(dim, where, limit, digits=4):
    share = "cnt / sum(cnt) OVER ()"
    return f"""SELECT label, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, label) AS INTEGER) AS rnk, round({share}, {digits}) AS ratio_of_shown
FROM (SELECT label, count(*) AS cnt FROM ({_dim_source(dim, where)}) GROUP BY label ORDER BY cnt DESC, label LIMIT {limit})"""


for _d in [*_DIMS, "hobby", "skill"]:
    def _dim(d=_d):
        @plan(f"AG11_dimension_{d}", _dim_sql(d, "province = 'ASIA' AND sex = '여자'", 10))
        def _(t):
            people = _seg(t, Segment(province=["ASIA"], sex="여자"))
            return stats.dimension_distribution(stats.dimension_values(d, people, t.hobbies, t.skills), 10)
    _dim()

_A = Segment(province=["ASIA"], sex="여자", match="equals")
_B = Segment(province=["EUROPE"], hobby=["Brand#1/ECONOMY", "Brand#2/SMALL", "Brand#3/LARGE"], match="equals")
_WA = "province = 'ASIA' AND sex = '여자'"
_WB = "province = 'EUROPE' AND uuid IN (SELECT uuid FROM q_hob WHERE item IN ('Brand#1/ECONOMY', 'Brand#2/SMALL', 'Brand#3/LARGE'))"


@plan("AG12_segment_size", f"SELECT count(DISTINCT uuid) AS total FROM q_persons WHERE {_WB}")
def _(t):
    return stats.total(_seg(t, _B))


@plan("AG13_segment_dimension", _dim_sql("hobby", _WB, 10, 6))
def _(t):
    d = stats.dimension_distribution(stats.dimension_values("hobby", _seg(t, _B), t.hobbies, t.skills), 10, digits=None)
    return d.withColumn("ratio_of_shown", F.round("ratio_of_shown", 6))


@plan("AG14_compare_segments", " UNION ALL ".join(f"""
SELECT '{d}' AS dimension, COALESCE(a.label, b.label) AS label, COALESCE(a.cnt, 0) AS cnt_a, COALESCE(a.ratio_of_shown, 0.0) AS ratio_a,
  COALESCE(b.cnt, 0) AS cnt_b, COALESCE(b.ratio_of_shown, 0.0) AS ratio_b,
  CASE WHEN a.label IS NULL THEN 'only_b' WHEN b.label IS NULL THEN 'only_a' ELSE 'common' END AS side
FROM ({_dim_sql(d, _WA, 10, 6)}) a FULL JOIN ({_dim_sql(d, _WB, 10, 6)}) b ON a.label = b.label""" for d in ("hobby", "occupation", "age")))
def _(t):
    return stats.compare(["hobby", "occupation", "age"], _seg(t, _A), _seg(t, _B), t.hobbies, t.skills, 10)


@plan("AG15_quality_checks", """
WITH v AS (SELECT 'country' AS name, country AS label FROM q_persons UNION ALL SELECT 'military_status', military_status FROM q_persons
  UNION ALL SELECT 'bachelors_field', bachelors_field FROM q_persons WHERE bachelors_field IS NOT NULL),
c AS (SELECT name, label, count(*) AS cnt FROM v GROUP BY ALL),
a AS (SELECT name, count(*) AS cardinality, CAST(sum(cnt) AS BIGINT) AS total, max(cnt) / sum(cnt) AS share FROM c GROUP BY name)
SELECT name, cardinality, total, round(share, 4) AS dominant_ratio,
  CASE WHEN cardinality <= 1 THEN CASE name WHEN 'country' THEN 'remove_node' ELSE 'hide_filter' END
       WHEN share >= 0.9 THEN 'hide_filter' WHEN share >= 0.75 THEN 'review' ELSE 'keep' END AS action,
  CASE WHEN cardinality <= 1 THEN 'high' WHEN share >= 0.9 THEN 'medium' WHEN share >= 0.75 THEN 'low' ELSE 'none' END AS severity FROM a""")
def _(t):
    checked = {"country": "remove_node", "military_status": "hide_filter", "bachelors_field": "hide_filter"}
    values = t.persons.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("label"), F.lit(a).alias("single_action"), F.lit("hide_filter").alias("skew_action"))
        for c, a in checked.items()])).alias("v")).select("v.*").where(F.col("label").isNotNull())
    return stats.quality_check(values)


@plan("AG16_structure_checks", """
SELECT 'province_edges' AS metric, count(*) AS value FROM q_edges WHERE rel = 'IN_PROVINCE'
UNION ALL SELECT 'districts', count(DISTINCT src) FROM q_edges WHERE rel = 'IN_PROVINCE'
UNION ALL SELECT 'country_edges', count(*) FROM q_edges WHERE dst_label = 'Country'
UNION ALL SELECT 'country_relations', count(DISTINCT rel) FROM q_edges WHERE dst_label = 'Country'
UNION ALL SELECT 'countries', count(DISTINCT dst) FROM q_edges WHERE dst_label = 'Country'""")
def _(t):
    return stats.structure_checks(t.edges)


@plan("AG18_edge_counts", "SELECT rel, count(*) AS cnt FROM q_edges GROUP BY rel")
def _(t):
    return t.edges.groupBy("rel").agg(F.count(F.lit(1)).alias("cnt"))


_SEARCH = Segment(province=["ASIA", "AMERICA"], age_min=25, age_max=70, occupation=["mach", "furn"], hobby=_H2 + ["Brand#4/SMALL"])
view("q_search", """
SELECT p.uuid, display_name, age, sex, persona, province, district, occupation, education_level
FROM q_persons p LEFT JOIN q_texts t ON p.uuid = t.uuid
WHERE province IN ('ASIA', 'AMERICA') AND age BETWEEN 25 AND 70 AND (contains(lower(occupation), 'mach') OR contains(lower(occupation), 'furn'))
  AND p.uuid IN (SELECT uuid FROM q_hob WHERE item IN ('Brand#1/ECONOMY', 'Brand#7/PROMO', 'Brand#4/SMALL'))""")


def _hits(t):
    return search.hits(t.persons, _SEARCH, t.hobbies, t.skills, t.texts)


@plan("SR01_faceted_search", "SELECT * FROM q_search")
def _(t):
    return _hits(t)


@plan("SR02_search_total", "SELECT count(*) AS total_count, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM q_search")
def _(t):
    return search.totals(_hits(t), 20)


@plan("SR03_search_page", "SELECT uuid, display_name, age FROM q_search ORDER BY age DESC, uuid LIMIT 5 OFFSET 5")
def _(t):
    return search.page(_hits(t), "age", "desc", number=2, size=5).select("uuid", "display_name", "age")


_TRAITS = ["province", "district", "country", "occupation", "education_level", "bachelors_field", "marital_status", "military_status", "family_type", "housing_type"]


@plan("PR01_profiles", " UNION ALL ".join(f"SELECT uuid, '{c}' AS attribute, {c} AS value FROM q_persons WHERE {c} IS NOT NULL" for c in _TRAITS)
      + " UNION ALL SELECT uuid, 'hobby', item FROM q_hob UNION ALL SELECT uuid, 'skill', skill FROM q_skl")
def _(t):
    return insights.profile_rows(t.persons, t.hobbies, t.skills)


@plan("PR03_graph_stats", """
SELECT p.uuid, count(e.src) AS total_connections, count(*) FILTER (rel = 'ENJOYS_HOBBY') AS hobby_count, count(*) FILTER (rel = 'HAS_SKILL') AS skill_count
FROM q_persons p LEFT JOIN q_edges e ON e.src = p.uuid AND src_label = 'Person' GROUP BY p.uuid""")
def _(t):
    return insights.graph_stats(t.persons, t.edges)


@plan("PR04_one_line_summary", "SELECT uuid, concat_ws(', ', display_name, CAST(age AS VARCHAR) || '세', district, occupation) AS summary FROM q_persons")
def _(t):
    return insights.one_line_summary(t.persons)


view("q_cohort", "SELECT * FROM q_persons WHERE contains(occupation, 'MACH') AND sex = '남자'")
_ITEMS = """SELECT name, cnt, round(cnt / (SELECT count(*) FROM q_cohort), 4) AS ratio
FROM ({counts} ORDER BY cnt DESC, name LIMIT 10) WHERE name <> ''"""


def _cohort(t):
    return insights.cohort(t.persons, "MACH", sex="남자")


@plan("CT01_career_cohort", "SELECT count(DISTINCT uuid) AS matched_count FROM q_cohort")
def _(t):
    return _cohort(t).agg(F.count(F.lit(1)).alias("matched_count"))


@plan("CT02_goal_terms", _ITEMS.format(counts="""
SELECT trim(g) AS name, count(*) AS cnt FROM (SELECT unnest(string_split(translate(career_goals, ';|/' || chr(10), ',,,,'), ',')) AS g
  FROM q_texts WHERE uuid IN (SELECT uuid FROM q_cohort)) WHERE length(trim(g)) >= 2 GROUP BY trim(g)"""))
def _(t):
    return insights.ranked_items(insights.goal_counts(_cohort(t), t.texts), 10, _cohort(t))


@plan("CT03_cohort_skills", _ITEMS.format(counts="SELECT skill AS name, count(*) AS cnt FROM q_skl WHERE uuid IN (SELECT uuid FROM q_cohort) GROUP BY skill"))
def _(t):
    return insights.ranked_items(insights.skill_counts(_cohort(t), t.skills), 10, _cohort(t))


@plan("CT04_adjacent_occupations", _ITEMS.format(counts="""
SELECT n.occupation AS name, count(DISTINCT n.uuid) AS cnt FROM q_cohort c JOIN q_hob h1 ON h1.uuid = c.uuid
JOIN q_hob h2 ON h1.item = h2.item JOIN q_persons n ON n.uuid = h2.uuid
WHERE n.uuid <> c.uuid AND n.occupation <> c.occupation GROUP BY n.occupation"""))
def _(t):
    counts = insights.neighbour_occupations(_cohort(t), t.persons, t.hobbies)
    return insights.ranked_items(counts, 10, _cohort(t))


@plan("CT05_segment_distribution", "SELECT age_group AS name, count(*) AS cnt FROM q_cohort WHERE age_group <> '' GROUP BY age_group")
def _(t):
    return insights.segment_counts(_cohort(t), "age_group")


@plan("CT06_ratio_items", _ITEMS.format(counts="SELECT province AS name, count(*) AS cnt FROM q_cohort GROUP BY province"))
def _(t):
    return insights.ranked_items(insights.segment_counts(_cohort(t), "province"), 10, _cohort(t))


_LM = ("sports_persona", "culinary_persona", "e", Segment(age_group=["20대", "30대", "40대", "50대"]))
view("q_life", """
SELECT t.uuid, culinary_persona AS target FROM q_texts t JOIN q_persons p ON p.uuid = t.uuid
WHERE contains(sports_persona, 'e') AND age_group IN ('20대', '30대', '40대', '50대')""")


def _life(t):
    return insights.lifestyle_source(t.persons, t.texts, *_LM)


@plan("LM01_source_count", "SELECT count(*) AS source_count FROM q_life")
def _(t):
    return _life(t).agg(F.count(F.lit(1)).alias("source_count"))


@plan("LM02_keyword_discovery", """
SELECT kw, cnt FROM (SELECT kw, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(target, '[가-힣A-Za-z0-9]{2,}')) AS kw FROM q_life)
  WHERE lower(kw) NOT IN (""" + ", ".join(f"'{w}'" for w in insights.STOPWORDS) + """) GROUP BY kw ORDER BY cnt DESC, kw LIMIT 10) WHERE cnt >= 2""")
def _(t):
    return insights.discover_keywords(_life(t), 10, 2)


@plan("LM03_keyword_overlap", """
SELECT kw, count(*) FILTER (contains(target, kw)) AS overlap_count, count(*) AS support_count,
  round(count(*) FILTER (contains(target, kw)) / count(*), 4) AS conditional_ratio
FROM q_life, (VALUES ('the'), ('de'), ('ing'), ('zzz')) k(kw) GROUP BY kw HAVING count(*) FILTER (contains(target, kw)) > 0""")
def _(t):
    return insights.keyword_overlap(_life(t), ["the", "de", "ing", "zzz"])


_TP = Segment(age_group=["30대"], province=["ASIA"], match="contains")
view("q_target", "SELECT * FROM q_persons WHERE age_group = '30대' AND province = 'ASIA'")
view("q_tsample", """SELECT CAST(row_number() OVER (ORDER BY age, p.uuid) AS INTEGER) AS pos, p.uuid, display_name, age, sex, province, district, occupation, persona
FROM q_target p LEFT JOIN q_texts t ON p.uuid = t.uuid ORDER BY age, p.uuid LIMIT 5""")
view("q_thob", "SELECT item AS name, count(*) AS cnt, CAST(row_number() OVER (ORDER BY count(*) DESC, item) AS INTEGER) AS rnk FROM q_hob WHERE uuid IN (SELECT uuid FROM q_target) GROUP BY item ORDER BY rnk LIMIT 5")
view("q_tskl", "SELECT skill AS name, count(*) AS cnt, CAST(row_number() OVER (ORDER BY count(*) DESC, skill) AS INTEGER) AS rnk FROM q_skl WHERE uuid IN (SELECT uuid FROM q_target) GROUP BY skill ORDER BY rnk LIMIT 5")


@plan("TP01_matched_count", "SELECT count(*) AS matched_count FROM q_target")
def _(t):
    return _seg(t, _TP).agg(F.count(F.lit(1)).alias("matched_count"))


@plan("TP02_sample", "SELECT * FROM q_tsample")
def _(t):
    return insights.target_sample(_seg(t, _TP), t.texts, 5)


@plan("TP03_representative_hobbies", "SELECT * FROM q_thob")
def _(t):
    return insights.representative_traits(insights.hobby_counts(_seg(t, _TP), t.hobbies))


@plan("TP04_representative_skills", "SELECT * FROM q_tskl")
def _(t):
    return insights.representative_traits(insights.skill_counts(_seg(t, _TP), t.skills))


@plan("TP05_representative_text", """
SELECT count(*) AS sample_size, string_agg(uuid, ',' ORDER BY pos) AS evidence_uuids,
  concat_ws(' ', '조건(age_group=30대, province=ASIA)에 맞는 페르소나 집합의 대표 프로필입니다.',
    (SELECT '핵심 성향: ' || persona FROM q_tsample WHERE pos = 1),
    (SELECT '주요 취미: ' || string_agg(name, ', ' ORDER BY rnk) FROM q_thob), (SELECT '주요 스킬: ' || string_agg(name, ', ' ORDER BY rnk) FROM q_tskl)) AS representative_text,
  '조건 기반 대표 페르소나를 한국어 3~5문장으로 합성하세요. 필터=age_group=30대, province=ASIA. 대표 취미=' || (SELECT string_agg(name, ', ' ORDER BY rnk) FROM q_thob)
    || '. 대표 스킬=' || (SELECT string_agg(name, ', ' ORDER BY rnk) FROM q_tskl) || '. 근거 샘플=' || string_agg(uuid, ',' ORDER BY pos) || '.' AS prompt
FROM q_tsample""")
def _(t):
    people = _seg(t, _TP)
    return insights.representative_text(
        {"age_group": "30대", "province": "ASIA"}, insights.target_sample(people, t.texts, 5),
        insights.representative_traits(insights.hobby_counts(people, t.hobbies)),
        insights.representative_traits(insights.skill_counts(people, t.skills)),
    )


GOLDEN_CASES = [
    {"id": "young-asia-machinery", "filters": {"age_group": ["30대"], "province": ["ASIA"], "occupation": ["MACHINERY"]}, "min_sample_size": 1},
    {"id": "forties-europe-hobby", "filters": {"age_group": ["40대"], "province": ["EUROPE"], "hobby": ["Brand#1/"]}, "min_sample_size": 1},
    {"id": "unknown-place", "filters": {"province": ["NOWHERE"]}, "min_sample_size": 0},
    {"id": "no-filter", "filters": {}, "reject": True},
]


@plan("TP06_golden_cases", """
SELECT 'young-asia-machinery' AS id, 'answered' AS outcome, count(*) AS matched, count(*) >= 1 AS passed FROM q_persons WHERE age_group = '30대' AND province = 'ASIA' AND contains(occupation, 'MACHINERY')
UNION ALL SELECT 'forties-europe-hobby', 'answered', count(*), count(*) >= 1 FROM q_persons WHERE age_group = '40대' AND province = 'EUROPE' AND uuid IN (SELECT uuid FROM q_hob WHERE contains(item, 'Brand#1/'))
UNION ALL SELECT 'unknown-place', 'answered', count(*), true FROM q_persons WHERE province = 'NOWHERE'
UNION ALL SELECT 'no-filter', 'rejected', CAST(0 AS BIGINT), true""")
def _(t):
    return insights.evaluate_cases(t.persons, GOLDEN_CASES, t.hobbies, t.skills)
