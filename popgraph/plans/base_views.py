"""SQL sub-queries that mirror the adapter in sources/tables.py."""

from popgraph.plans.registry import view

view("q_persons", """
SELECT CAST(c_custkey AS VARCHAR) AS uuid, c_name AS display_name,
  CAST(19 + c_custkey % 81 AS INTEGER) AS age,
  CAST((19 + c_custkey % 81) // 10 * 10 AS VARCHAR) || '대' AS age_group,
  CASE WHEN c_custkey % 2 = 0 THEN '여자' ELSE '남자' END AS sex,
  c_mktsegment AS occupation, n_name AS district, r_name || '-' || n_name AS district_key,
  r_name AS province, '대한민국' AS country,
  'm' || CAST(c_custkey % 4 AS VARCHAR) AS marital_status,
  CASE WHEN c_custkey % 20 = 0 THEN '현역' ELSE '비현역' END AS military_status,
  'f' || CAST(c_custkey % 39 AS VARCHAR) AS family_type,
  'h' || CAST(c_custkey % 6 AS VARCHAR) AS housing_type,
  'e' || CAST(c_custkey % 7 AS VARCHAR) AS education_level,
  CASE WHEN c_custkey % 3 <> 0 THEN 'b' || CAST(c_custkey % 10 AS VARCHAR) END AS bachelors_field
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

view("q_texts", """
SELECT uuid, """ + ", ".join(
    f"NULLIF(trim(lines[{i + 1}]), '') AS {c}"
    for i, c in enumerate(
        ["persona", "professional_persona", "sports_persona", "arts_persona", "travel_persona",
         "culinary_persona", "family_persona"])
) + """,
  CASE WHEN len(lines) > 7 THEN NULLIF(trim(array_to_string(lines[8:], chr(10))), '') END AS career_goals
FROM (SELECT CAST(doc_id AS VARCHAR) AS uuid, string_split(text, chr(10)) AS lines FROM documents)""")

view("q_hob", """
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS uuid, p_brand || '/' || p_type AS item
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE l_quantity >= 45""")

view("q_skl", """
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS uuid, 's' || CAST(l_suppkey AS VARCHAR) AS skill
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity <= 5""")

view("q_hobby_lists", """
SELECT uuid, string_agg(item, '; ' ORDER BY item) AS hobbies_text FROM q_hob GROUP BY uuid""")

_TEXTS = {
    "persona_text": "persona", "professional_text": "professional_persona", "sports_text": "sports_persona",
    "arts_text": "arts_persona", "travel_text": "travel_persona", "culinary_text": "culinary_persona",
    "family_text": "family_persona", "hobbies_text": "hobbies_text",
}
view("q_ctx", """
SELECT p.uuid AS person_uuid, CAST(age AS VARCHAR) AS age, age_group, sex, occupation, district, province,
  family_type, housing_type, education_level, """ + ", ".join(
    f"COALESCE(trim({s}), '') AS {d}" for d, s in _TEXTS.items()
) + """, '' AS skills_text, COALESCE(trim(career_goals), '') AS career_goals,
  concat_ws(' ', persona, professional_persona, sports_persona, arts_persona, travel_persona, culinary_persona,
            family_persona, province, district, occupation, hobbies_text) AS embedding_text
FROM q_persons p LEFT JOIN q_texts t ON p.uuid = t.uuid LEFT JOIN q_hobby_lists h ON p.uuid = h.uuid""")

view("q_vec", """
SELECT CAST(vec_id AS VARCHAR) AS uuid, embedding, label FROM embeddings""")
