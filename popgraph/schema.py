"""Relation names, dimensions and explicit schemas shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

COUNTRY = "대한민국"
NOT_APPLICABLE = "해당없음"

# Trait carried by one person column: relation -> (column, node label).
SINGLE_RELATIONS = {
    "LIVES_IN": ("district_key", "District"),
    "WORKS_AS": ("occupation", "Occupation"),
    "EDUCATED_AT": ("education_level", "EducationLevel"),
    "MAJORED_IN": ("bachelors_field", "Field"),
    "MARITAL_STATUS": ("marital_status", "MaritalStatus"),
    "MILITARY_STATUS": ("military_status", "MilitaryStatus"),
    "LIVES_WITH": ("family_type", "FamilyType"),
    "LIVES_IN_HOUSING": ("housing_type", "HousingType"),
}
LIST_RELATIONS = {
    "ENJOYS_HOBBY": ("item", "Hobby"),
    "HAS_SKILL": ("skill", "Skill"),
}

# Dimension name -> person column; hobby and skill are edge tables.
DIMENSIONS = {
    "age": "age_group",
    "sex": "sex",
    "province": "province",
    "district": "district",
    "occupation": "occupation",
    "education": "education_level",
    "marital": "marital_status",
    "military": "military_status",
    "family_type": "family_type",
    "housing": "housing_type",
    "hobby": None,
    "skill": None,
}

# Persona text columns, in the order the lines of a document fill them.
PERSONA_TEXTS = [
    "persona",
    "professional_persona",
    "sports_persona",
    "arts_persona",
    "travel_persona",
    "culinary_persona",
    "family_persona",
    "career_goals",
]

# Raw persona table: 25 strings and one integer.
RAW_PERSONA_COLUMNS = [
    "uuid",
    "professional_persona",
    "sports_persona",
    "arts_persona",
    "travel_persona",
    "culinary_persona",
    "family_persona",
    "persona",
    "cultural_background",
    "skills_and_expertise",
    "skills_and_expertise_list",
    "hobbies_and_interests",
    "hobbies_and_interests_list",
    "career_goals_and_ambitions",
    "sex",
    "age",
    "marital_status",
    "military_status",
    "family_type",
    "housing_type",
    "education_level",
    "bachelors_field",
    "occupation",
    "district",
    "province",
    "country",
]
RAW_PERSONA_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType() if c == "age" else T.StringType()) for c in RAW_PERSONA_COLUMNS]
)

CONTEXT_COLUMNS = [
    "person_uuid",
    "age",
    "age_group",
    "sex",
    "occupation",
    "district",
    "province",
    "family_type",
    "housing_type",
    "education_level",
    "persona_text",
    "professional_text",
    "sports_text",
    "arts_text",
    "travel_text",
    "culinary_text",
    "family_text",
    "hobbies_text",
    "skills_text",
    "career_goals",
    "embedding_text",
]
# Demographic columns whose value histograms make up an item profile.
PROFILE_FIELDS = [
    "age_group",
    "sex",
    "occupation",
    "district",
    "province",
    "family_type",
    "housing_type",
    "education_level",
]
# Text columns searched by the hold-out leakage audit.
LEAKAGE_TEXT_FIELDS = [
    "persona_text",
    "professional_text",
    "sports_text",
    "arts_text",
    "travel_text",
    "culinary_text",
    "family_text",
    "hobbies_text",
    "embedding_text",
]


def require_columns(df, required):
    """Fail with the names of the columns a table lacks."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df
