import json

import pytest
from pyspark.sql import functions as F

from popgraph.operators import filters, prep
from popgraph.operators import vocabulary as voc
from popgraph.schema import CONTEXT_COLUMNS, RAW_PERSONA_COLUMNS, require_columns
from popgraph.sources import files


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,want", [
    ("['가계부 정밀 기록', ' 서류 보관 ', '']", ["가계부 정밀 기록", "서류 보관"]), ("not a list", []), ("", []), (None, []), ("[]", []),
])
def test_parse_list(spark, text, want):
    assert one(spark, prep.parse_list, text) == want


def test_split_district(spark):
    assert tuple(one(spark, prep.split_district, "서울-서초구")) == ("서울", "서초구")
    assert tuple(one(spark, prep.split_district, "서초구")) == ("", "서초구")


@pytest.mark.parametrize("age,want", [("31", "30대"), ("74", "70대"), (None, "")])
def test_age_group(spark, age, want):
    assert one(spark, prep.age_group, age) == want


def test_preprocess_row(spark):
    row = {c: None for c in RAW_PERSONA_COLUMNS} | {
        "uuid": "u", "age": 71, "district": "서울-서초구", "province": "서울", "bachelors_field": "해당없음",
        "persona": "최은지 씨는 산책을 좋아한다", "occupation": "교사",
        "skills_and_expertise_list": "['기술']", "hobbies_and_interests_list": "['산책', '독서']",
    }
    from popgraph.schema import RAW_PERSONA_SCHEMA

    df = spark.createDataFrame([tuple(row.get(f.name) for f in RAW_PERSONA_SCHEMA)], RAW_PERSONA_SCHEMA)
    got = prep.preprocess(df).first()
    assert (got["age_group"], got["province_cleaned"], got["district_cleaned"]) == ("70대", "서울", "서초구")
    assert got["bachelors_field"] is None and got["display_name"] == "최은지"
    assert got["hobbies_and_interests_list"] == ["산책", "독서"] and "기술" in got["embedding_text"]
    graph = prep.graph_row(prep.preprocess(df)).first()
    assert graph["district_key"] == "서울-서초구" and graph["country"] == "대한민국"


def test_duplicates_are_rejected(spark):
    with pytest.raises(ValueError):
        prep.reject_duplicate_uuids(spark.createDataFrame([("a",), ("a",)], "uuid string"))


def test_sample_age_groups_quota(spark):
    groups = ["20대", "30대", "40대"]
    df = spark.range(12000).select(F.col("id").cast("string").alias("uuid"), F.element_at(F.array(*[F.lit(g) for g in groups]), (F.col("id") % 3 + 1).cast("int")).alias("age_group"))
    got = dict(prep.sample_age_groups(df, groups, 10000).groupBy("age_group").count().collect())
    assert got == {"20대": 3333, "30대": 3333, "40대": 3334}
    assert prep.sample_age_groups(df.limit(3), groups, 10000).count() == 3
    assert prep.sample_age_groups(df, groups, 0).count() == 0


def test_required_columns(spark):
    with pytest.raises(ValueError, match="persona"):
        require_columns(spark.range(1), ["id", "persona"])


def test_edge_file_with_bom(spark, tmp_path):
    path = tmp_path / "edges.csv"
    path.write_text("﻿person_uuid,hobby_name\np1, 등산 \np1,등산\n,독서\np2,독서\n", encoding="utf-8")
    got = {tuple(r) for r in files.read_edges(spark, str(path)).collect()}
    assert got == {("p1", "등산"), ("p2", "독서")}
    bad = tmp_path / "bad.csv"
    bad.write_text("person,hobby\np1,등산\n", encoding="utf-8")
    with pytest.raises(ValueError):
        files.read_edges(spark, str(bad))


def test_context_last_row_wins(spark, tmp_path):
    path = tmp_path / "ctx.csv"
    rest = "," * (len(CONTEXT_COLUMNS) - 2)
    path.write_text(",".join(CONTEXT_COLUMNS) + "\n" + f"p1,30{rest}\n" + f"p1, 31 {rest}\n" + f",9{rest}\n", encoding="utf-8")
    rows = files.read_contexts(spark, str(path)).collect()
    assert [(r["person_uuid"], r["age"], r["sex"]) for r in rows] == [("p1", "31", "")]


def test_alias_map_rejects_conflicts(spark, tmp_path):
    path = tmp_path / "alias.json"
    path.write_text(json.dumps({"등산하기": "등산", " 등산하기 ": "등산"}), encoding="utf-8")
    assert [tuple(r) for r in files.read_alias_map(spark, str(path)).collect()] == [("등산하기", "등산")]
    path.write_text(json.dumps({"등산하기": "등산", " 등산하기": "산책"}), encoding="utf-8")
    with pytest.raises(ValueError):
        files.read_alias_map(spark, str(path))


def test_missing_review_is_empty(spark):
    assert all(df.isEmpty() for df in files.read_review(spark, None).values())


def test_upsert_overwrites_only_supplied(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "uuid string, name string, n int")
    new = spark.createDataFrame([("b", None, 5), ("c", "z", 6)], "uuid string, name string, n int")
    got = {r["uuid"]: (r["name"], r["n"]) for r in files.upsert(old, new).collect()}
    assert got == {"a": ("x", 1), "b": ("y", 5), "c": ("z", 6)}


def test_normalise_and_canonicalise(spark):
    raw = spark.createDataFrame([("p1", " ＡBC  운동 "), ("p1", "동네 산책하기"), ("p2", "등산하기"), ("p2", "유튜브 산책 영상")], "uuid string, raw string")
    aliases = spark.createDataFrame([("등산하기", "등산")], "raw string, canonical string")
    rules = [{"canonical": "산책", "include": ["산책"], "exclude": ["유튜브"]}]
    got = {r["raw"]: r["item"] for r in voc.prepare_edges(raw, aliases, rules).collect()}
    assert got == {" ＡBC  운동 ": "abc 운동", "동네 산책하기": "산책", "등산하기": "등산", "유튜브 산책 영상": "유튜브 산책 영상"}


def test_rare_policy(spark):
    edges = spark.createDataFrame([("a", "x", "x"), ("b", "x", "x"), ("a", "y", "y")], "uuid string, raw string, item string")
    assert voc.apply_rare_policy(edges, 2, "drop").count() == 2
    assert voc.apply_rare_policy(edges, 2, "keep_with_fallback").where("rare").count() == 1
    with pytest.raises(ValueError):
        voc.apply_rare_policy(edges, 0, "drop")


def test_parameter_rules():
    assert filters.parse_age_groups("10,20대,30") == ["10대", "20대", "30대"]
    assert filters.normalize_sex("여성") == "여자" and filters.normalize_sex(" ") is None
    assert filters.compact_term(" Data-Sci/ence. ") == "datascience"
    with pytest.raises(ValueError):
        filters.require_filters(filters.Segment())
