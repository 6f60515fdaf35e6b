"""Sources, preprocessing and graph model (IO*, PP*, GM*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from popgraph.functions.columns import blank_to_null, clean_list
from popgraph.operators import model, prep
from popgraph.plans.registry import plan, view
from popgraph.schema import RAW_PERSONA_COLUMNS, require_columns
from popgraph.sources import files

view("q_raw", """
SELECT p.uuid, professional_persona, sports_persona, arts_persona, travel_persona, culinary_persona, family_persona,
  (['최은지', '김민수', '이서연'])[age % 3 + 1] || ' 씨는 ' || COALESCE(persona, '') AS persona,
  career_goals AS career_goals_and_ambitions, sex, CAST(age AS BIGINT) AS age, marital_status, military_status,
  family_type, housing_type, education_level, bachelors_field, occupation, district_key, district, province, country,
  (SELECT string_agg(skill, ' ' ORDER BY skill) FROM q_skl s WHERE s.uuid = p.uuid) AS skills_text,
  (SELECT string_agg(item, ' ' ORDER BY item) FROM q_hob h WHERE h.uuid = p.uuid) AS hobbies_joined
FROM q_persons p LEFT JOIN q_texts t ON p.uuid = t.uuid""")

view("q_nodes", """
SELECT 'Person' AS label, uuid AS key, display_name AS name FROM q_persons
UNION ALL SELECT 'Hobby', item, item FROM (SELECT DISTINCT item FROM q_hob)
UNION ALL SELECT 'Skill', skill, skill FROM (SELECT DISTINCT skill FROM q_skl)
""" + "".join(
    f"UNION ALL SELECT '{label}', {c}, {n} FROM (SELECT DISTINCT {c}{', ' + n if n != c else ''} FROM q_persons WHERE {c} IS NOT NULL)\n"
    for label, c, n in [
        ("District", "district_key", "district"), ("Province", "province", "province"),
        ("Country", "country", "country"), ("Occupation", "occupation", "occupation"),
        ("EducationLevel", "education_level", "education_level"), ("Field", "bachelors_field", "bachelors_field"),
        ("MaritalStatus", "marital_status", "marital_status"), ("MilitaryStatus", "military_status", "military_status"),
        ("FamilyType", "family_type", "family_type"), ("HousingType", "housing_type", "housing_type")]))

view("q_edges", "".join(
    f"SELECT uuid AS src, 'Person' AS src_label, '{rel}' AS rel, {c} AS dst, '{label}' AS dst_label FROM q_persons WHERE {c} IS NOT NULL UNION ALL\n"
    for rel, c, label in [
        ("LIVES_IN", "district_key", "District"), ("WORKS_AS", "occupation", "Occupation"),
        ("EDUCATED_AT", "education_level", "EducationLevel"), ("MAJORED_IN", "bachelors_field", "Field"),
        ("MARITAL_STATUS", "marital_status", "MaritalStatus"), ("MILITARY_STATUS", "military_status", "MilitaryStatus"),
        ("LIVES_WITH", "family_type", "FamilyType"), ("LIVES_IN_HOUSING", "housing_type", "HousingType")]) + """
SELECT uuid, 'Person', 'ENJOYS_HOBBY', item, 'Hobby' FROM q_hob UNION ALL
SELECT uuid, 'Person', 'HAS_SKILL', skill, 'Skill' FROM q_skl UNION ALL
SELECT DISTINCT district_key, 'District', 'IN_PROVINCE', province, 'Province' FROM q_persons UNION ALL
SELECT DISTINCT province, 'Province', 'IN_COUNTRY', country, 'Country' FROM q_persons""")

view("q_und", """
SELECT src_label || ':' || src AS src, dst_label || ':' || dst AS dst, rel FROM q_edges UNION ALL
SELECT dst_label || ':' || dst, src_label || ':' || src, rel FROM q_edges""")


@plan("IO01_persona_scan", "SELECT uuid, age, sex, district_key AS district, persona FROM q_raw")
def _(t):
    path = files.scratch_path(t.spark, "personas")
    t.raw_personas.write.parquet(path)
    return files.load_personas(t.spark, path).select("uuid", "age", "sex", "district", "persona")


@plan("IO02_row_limited_scan", "SELECT uuid, age FROM q_raw ORDER BY uuid LIMIT 100")
def _(t):
    path = files.scratch_path(t.spark, "personas-csv")
    t.raw_personas.write.csv(path, header=True, escape='"')
    return files.load_personas(t.spark, None, path, rows=100).select("uuid", "age")


@plan("IO03_required_columns", "SELECT count(*) AS rows, CAST(26 AS INTEGER) AS required_columns FROM q_persons")
def _(t):
    df = require_columns(t.raw_personas, RAW_PERSONA_COLUMNS)
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("required_columns", F.lit(len(RAW_PERSONA_COLUMNS)))


@plan("IO04_edge_csv", "SELECT uuid AS person_uuid, item AS hobby_name FROM q_hob")
def _(t):
    path = files.scratch_path(t.spark, "edges")
    rows = t.hobbies.select(F.col("uuid").alias("person_uuid"), F.concat(F.lit(" "), "item").alias("hobby_name"))
    rows.unionByName(rows).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_edges(t.spark, path)


@plan("IO05_context_csv", "SELECT person_uuid, age_group, province, persona_text, length(embedding_text) AS text_chars FROM q_ctx")
def _(t):
    path = files.scratch_path(t.spark, "contexts")
    t.contexts.write.csv(path, header=True, escape='"')
    out = files.read_contexts(t.spark, path)
    return out.select(
        "person_uuid", "age_group", "province", "persona_text", F.length("embedding_text").cast("long").alias("text_chars")
    )


@plan("IO10_edge_export", "SELECT DISTINCT uuid AS person_uuid, item AS hobby_name FROM q_hob")
def _(t):
    return t.edges.where(F.col("rel") == "ENJOYS_HOBBY").select(
        F.col("src").alias("person_uuid"), F.col("dst").alias("hobby_name")
    ).distinct()


@plan("IO11_context_export", """
SELECT person_uuid, age, age_group, sex, occupation, district, province, family_type, housing_type, education_level,
  md5(concat_ws('|', persona_text, professional_text, sports_text, hobbies_text, career_goals)) AS text_key FROM q_ctx""")
def _(t):
    return t.contexts.select(
        "person_uuid", "age", "age_group", "sex", "occupation", "district", "province", "family_type", "housing_type",
        "education_level",
        F.md5(F.concat_ws("|", "persona_text", "professional_text", "sports_text", "hobbies_text", "career_goals")).alias("text_key"),
    )


@plan("IO12_json_sink", "SELECT rel, count(*) AS cnt FROM q_edges GROUP BY rel")
def _(t):
    path = files.scratch_path(t.spark, "artifact")
    files.write_json(t.edges.groupBy("rel").agg(F.count(F.lit(1)).alias("cnt")), path)
    return t.spark.read.schema("rel string, cnt long").json(path)


@plan("IO13_upsert_persons", """
WITH old AS (SELECT uuid, display_name, occupation FROM q_persons WHERE age_group <> '90대'),
new AS (SELECT uuid, CASE WHEN age % 2 = 0 THEN 'moved' END AS occupation, age FROM q_persons WHERE age >= 80)
SELECT COALESCE(old.uuid, new.uuid) AS uuid, display_name, COALESCE(new.occupation, old.occupation) AS occupation, age
FROM old FULL JOIN new ON old.uuid = new.uuid""")
def _(t):
    old = t.persons.where(F.col("age_group") != "90대").select("uuid", "display_name", "occupation")
    new = t.persons.where(F.col("age") >= 80).select(
        "uuid", F.when(F.col("age") % 2 == 0, "moved").alias("occupation"), "age"
    )
    return files.upsert(old, new)


@plan("IO14_incremental_load", """
SELECT uuid, display_name FROM q_persons WHERE uuid NOT IN (SELECT uuid FROM q_vec)""")
def _(t):
    return files.only_new(t.persons.select("uuid", "display_name"), t.vectors)


@plan("IO15_unembedded_rows", """
SELECT person_uuid, length(embedding_text) AS text_chars FROM q_ctx
WHERE NOT EXISTS (SELECT 1 FROM q_vec WHERE q_vec.uuid = person_uuid)""")
def _(t):
    todo = files.only_new(t.contexts, t.vectors.withColumnRenamed("uuid", "person_uuid"), "person_uuid")
    return todo.select("person_uuid", F.length("embedding_text").cast("long").alias("text_chars"))


@plan("IO16_reset", "SELECT count(*) AS cleared, CAST(0 AS BIGINT) AS remaining FROM q_nodes")
def _(t):
    path = files.scratch_path(t.spark, "nodes")
    cleared = files.replace_snapshot(t.nodes, path)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("remaining")).withColumn("cleared", F.lit(cleared).cast("long"))


@plan("IO17_attach_vectors", """
SELECT p.uuid, len(embedding) AS dims, round(embedding[1], 6) AS first_value FROM q_persons p LEFT JOIN q_vec v ON p.uuid = v.uuid""")
def _(t):
    df = files.attach_vectors(t.persons.select("uuid"), t.vectors)
    return df.select(
        "uuid",
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("dims"),
        F.round(F.get("embedding", F.lit(0)), 6).alias("first_value"),
    )


@plan("IO18_preview", """
SELECT 'rows' AS part, CAST(0 AS INTEGER) AS position, CAST(count(*) AS VARCHAR) AS value FROM q_hob
UNION ALL SELECT 'column', CAST(i AS INTEGER), c FROM (VALUES (0, 'uuid'), (1, 'item')) v(i, c)
UNION ALL SELECT 'head', CAST(row_number() OVER (ORDER BY uuid) - 1 AS INTEGER), uuid FROM (SELECT uuid FROM q_hob ORDER BY uuid LIMIT 2)""")
def _(t):
    return files.preview(t.hobbies)


@plan("PP01_parse_lists", "SELECT uuid, item FROM q_hob")
def _(t):
    return t.raw_personas.select("uuid", F.explode(prep.parse_list(F.col("hobbies_and_interests_list"))).alias("item"))


@plan("PP02_split_district", "SELECT uuid, province, district FROM q_persons")
def _(t):
    return t.raw_personas.select("uuid", prep.split_district(F.col("district")).alias("d")).select("uuid", "d.province", "d.district")


@plan("PP03_age_group", "SELECT uuid, age_group FROM q_persons")
def _(t):
    return t.raw_personas.select("uuid", prep.age_group(F.col("age")).alias("age_group"))


_EMBED = """concat_ws(' ', professional_persona, sports_persona, arts_persona, travel_persona, culinary_persona,
  family_persona, persona, province, district, occupation, COALESCE(skills_text, ''), COALESCE(hobbies_joined, ''))"""


@plan("PP04_preprocess", f"""
SELECT uuid, province AS province_cleaned, district AS district_cleaned, age_group_of AS age_group,
  (SELECT count(*) FROM q_skl s WHERE s.uuid = r.uuid) AS n_skills, (SELECT count(*) FROM q_hob h WHERE h.uuid = r.uuid) AS n_hobbies
FROM (SELECT *, CAST(age // 10 * 10 AS VARCHAR) || '대' AS age_group_of FROM q_raw) r""")
def _(t):
    return prep.preprocess(t.raw_personas).select(
        "uuid", "province_cleaned", "district_cleaned", "age_group",
        F.size("skills_and_expertise_list").cast("long").alias("n_skills"),
        F.size("hobbies_and_interests_list").cast("long").alias("n_hobbies"),
    )


@plan("PP05_sentinel_to_null", "SELECT uuid, bachelors_field FROM q_persons")
def _(t):
    return prep.preprocess(t.raw_personas).select("uuid", "bachelors_field")


@plan("PP06_display_name", "SELECT uuid, (['최은지', '김민수', '이서연'])[age % 3 + 1] AS display_name FROM q_persons")
def _(t):
    return prep.preprocess(t.raw_personas).select("uuid", "display_name")


@plan("PP07_embedding_text", f"SELECT uuid, md5({_EMBED}) AS text_key FROM (SELECT * REPLACE (NULLIF(trim(persona), '') AS persona) FROM q_raw)")
def _(t):
    return prep.preprocess(t.raw_personas).select("uuid", F.md5("embedding_text").alias("text_key"))


@plan("PP08_duplicate_uuid", "SELECT CAST(o_custkey AS VARCHAR) AS uuid, count(*) AS copies FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def _(t):
    return prep.duplicate_uuids(t.raw("orders").select(F.col("o_custkey").cast("string").alias("uuid")))


@plan("PP10_sample_age_groups", """
WITH g AS (SELECT uuid, age_group, row_number() OVER (PARTITION BY age_group ORDER BY md5(concat_ws(':', uuid, '42'))) AS rn
  FROM q_persons WHERE age_group IN ('20대', '30대', '40대')),
n AS (SELECT count(*) AS all_rows FROM g)
SELECT uuid, age_group FROM g, n WHERE all_rows <= 100 OR rn <= CASE age_group WHEN '40대' THEN 34 ELSE 33 END""")
def _(t):
    return prep.sample_age_groups(t.persons.select("uuid", "age_group"), ["20대", "30대", "40대"], 100)


@plan("PP11_filter_age_groups", "SELECT uuid, age_group FROM q_persons WHERE age_group IN ('50대', '60대')")
def _(t):
    return prep.filter_age_groups(t.persons.select("uuid", "age_group"), ["50대", "60대"])


@plan("PP12_clean_values", "SELECT doc_id, NULLIF(trim(string_split(text, chr(10))[2]), '') AS second_line FROM documents")
def _(t):
    return t.raw("documents").select(
        "doc_id", blank_to_null(F.get(F.split("text", "\n"), F.lit(1))).alias("second_line")
    )


@plan("PP13_clean_lists", """
SELECT doc_id, CAST(len(l) AS INTEGER) AS entries, md5(COALESCE(array_to_string(l, chr(10)), '')) AS key FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x : trim(x)), lambda x : x <> '') AS l FROM documents)""")
def _(t):
    lines = clean_list(F.split("text", "\n"))
    return t.raw("documents").select("doc_id", F.size(lines).alias("entries"), F.md5(F.array_join(lines, "\n")).alias("key"))


@plan("PP14_graph_rows", "SELECT uuid, country, province, district, province || '-' || district AS district_key FROM q_persons")
def _(t):
    return prep.graph_row(prep.preprocess(t.raw_personas)).select("uuid", "country", "province", "district", "district_key")


_PROPS = ["display_name", "sex", "occupation", "bachelors_field", "age_group"]


@plan("PP15_property_map", " UNION ALL ".join(
    f"SELECT uuid, '{c}' AS property, {c} AS value FROM q_persons WHERE {c} IS NOT NULL" for c in _PROPS))
def _(t):
    return t.persons.select("uuid", F.explode(prep.property_map(_PROPS)).alias("property", "value"))


_ITEMS = r"""list_filter(list_transform(regexp_split_to_array(text, '[;,.]\s*'), lambda x : trim(x)), lambda x : length(x) > 1)"""


@plan("PP16_split_items", f"""
SELECT doc_id, CAST(len(l) AS INTEGER) AS items, md5(COALESCE(array_to_string(l, '|'), '')) AS key FROM (SELECT doc_id, {_ITEMS} AS l FROM documents)""")
def _(t):
    parts = prep.split_items(F.col("text"))
    return t.raw("documents").select("doc_id", F.size(parts).alias("items"), F.md5(F.array_join(parts, "|")).alias("key"))


@plan("PP18_domain_tagged_text", """
SELECT person_uuid, md5(concat_ws(' ', '[PROF] ' || NULLIF(trim(professional_text), ''), '[SPORT] ' || NULLIF(trim(sports_text), ''),
  '[ART] ' || NULLIF(trim(arts_text), ''), '[TRAV] ' || NULLIF(trim(travel_text), ''), '[FOOD] ' || NULLIF(trim(culinary_text), ''),
  '[FAM] ' || NULLIF(trim(family_text), ''))) AS text_key FROM q_ctx""")
def _(t):
    return t.contexts.select("person_uuid", F.md5(prep.domain_tagged_text(t.contexts.columns)).alias("text_key"))


@plan("GM01_nodes", "SELECT label, key, name FROM q_nodes")
def _(t):
    return t.nodes


@plan("GM02_edges", "SELECT src, src_label, rel, dst, dst_label FROM q_edges")
def _(t):
    return t.edges


@plan("GM03_likes", f"""
SELECT item, count(*) AS persons FROM (SELECT DISTINCT doc_id, unnest({_ITEMS}) AS item FROM documents) GROUP BY item""")
def _(t):
    pairs = model.likes(t.raw("documents"), "doc_id", "text")
    return pairs.groupBy("item").agg(F.count(F.lit(1)).alias("persons"))


@plan("GM04_duplicate_keys", """
SELECT label, count(*) - count(DISTINCT key) AS duplicate_rows FROM q_nodes GROUP BY label""")
def _(t):
    per_label = t.nodes.groupBy("label").agg(F.lit(0).cast("long").alias("zero"))
    dup = model.duplicate_keys(t.nodes).groupBy("label").agg(F.sum(F.col("copies") - 1).alias("n"))
    return per_label.join(dup, "label", "left").select("label", F.coalesce("n", "zero").alias("duplicate_rows"))


@plan("GM05_count_by_label", "SELECT label, count(*) AS cnt FROM q_nodes GROUP BY label")
def _(t):
    return model.count_by_label(t.nodes)


@plan("GM06_projection", """
SELECT 'nodes' AS part, count(*) AS cnt FROM q_nodes UNION ALL SELECT 'relationships', count(*) FROM q_und""")
def _(t):
    return model.projection_counts(t.nodes, t.edges)


@plan("GM07_projection_with_vectors", """
SELECT p.uuid AS key, v.uuid IS NOT NULL AS has_vector FROM q_persons p LEFT JOIN q_vec v ON p.uuid = v.uuid""")
def _(t):
    return model.with_vectors(t.nodes, t.vectors).select("key", F.col("embedding").isNotNull().alias("has_vector"))
