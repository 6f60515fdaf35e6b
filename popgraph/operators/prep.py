"""Scalar shaping of raw persona rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgraph.functions.columns import blank_to_null, clean_list, shuffle_key
from popgraph.functions.skew import hashed_row_number
from popgraph.schema import COUNTRY, NOT_APPLICABLE

# Fixed patterns: a quoted entry of a Python list literal, the name before the honorific, the
# separators between free-text items.
LIST_ENTRY = r"""'([^']*)'|"([^"]*)\""""
NAME_BEFORE_HONORIFIC = r"^([가-힣]{2,4})\s*씨"
ITEM_SEPARATOR = r"[;,.]\s*"


def parse_list(c: Column) -> Column:
    """Entries of a list literal such as "['a', ' b ']", trimmed; anything else gives an empty list."""
    single = F.regexp_extract_all(c, F.lit(LIST_ENTRY), F.lit(0))
    entries = F.transform(single, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    empty = F.array().cast("array<string>")
    return F.when(c.rlike(r"^\s*\[[\s\S]*\]\s*$"), clean_list(entries)).otherwise(empty)


def split_district(c: Column) -> Column:
    """(province, district) of "province-district"; without a separator the province is blank."""
    at = F.locate("-", c)
    return F.struct(
        F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(F.lit("")).alias("province"),
        F.when(at > 0, F.substring(c, at + 1, F.length(c))).otherwise(F.coalesce(c, F.lit(""))).alias("district"),
    )


def age_group(age: Column) -> Column:
    decade = F.floor(age.cast("double") / 10).cast("int") * 10
    return F.coalesce(F.concat(decade.cast("string"), F.lit("대")), F.lit(""))


def split_items(text: Column) -> Column:
    """Items of a free text: split at ; , . and keep entries longer than one character."""
    parts = F.transform(F.split(text, ITEM_SEPARATOR), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.length(x) > 1)


def preprocess(df: DataFrame) -> DataFrame:
    """Parsed lists, cleaned location, age group, display name and embedding text."""
    place = split_district(F.col("district"))
    skills, hobbies = parse_list(F.col("skills_and_expertise_list")), parse_list(F.col("hobbies_and_interests_list"))
    texts = [
        "professional_persona", "sports_persona", "arts_persona", "travel_persona",
        "culinary_persona", "family_persona", "persona",
    ]
    return (
        df.withColumn("district_cleaned", place["district"])
        .withColumn("province_cleaned", F.coalesce(blank_to_null(place["province"]), F.col("province")))
        .withColumn("age_group", age_group(F.col("age")))
        .withColumn("bachelors_field", F.nullif(F.col("bachelors_field"), F.lit(NOT_APPLICABLE)))
        .withColumn("display_name", blank_to_null(F.regexp_extract("persona", NAME_BEFORE_HONORIFIC, 1)))
        .withColumn("skills_and_expertise_list", skills)
        .withColumn("hobbies_and_interests_list", hobbies)
        .withColumn(
            "embedding_text",
            F.concat_ws(
                " ", *[blank_to_null(F.col(c)) for c in texts], "province_cleaned", "district_cleaned", "occupation",
                F.array_join("skills_and_expertise_list", " "), F.array_join("hobbies_and_interests_list", " "),
            ),
        )
    )


def duplicate_uuids(df: DataFrame, key: str = "uuid") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def reject_duplicate_uuids(df: DataFrame, key: str = "uuid") -> DataFrame:
    sample = [r[0] for r in duplicate_uuids(df, key).select(key).limit(5).collect()]
    if sample:
        raise ValueError(f"duplicate uuid values, e.g. {', '.join(map(str, sample))}")
    return df


def filter_age_groups(df: DataFrame, groups: list[str]) -> DataFrame:
    return df.where(F.col("age_group").isin(groups))


def sample_age_groups(df: DataFrame, groups: list[str], max_rows: int, seed: int = 42) -> DataFrame:
    """Even quota per group, the remainder goes to the last group; the pick is seeded by uuid."""
    if max_rows <= 0 or not groups:
        return df.limit(0)
    wanted = filter_age_groups(df, groups)
    share, rest = divmod(max_rows, len(groups))
    quota = F.when(F.col("age_group") == groups[-1], share + rest).otherwise(share)
    ranked = hashed_row_number(wanted, ["age_group"], shuffle_key("uuid", seed=seed), "__rank")
    total = Window.partitionBy()
    sizes = ranked.groupBy("age_group").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__all", F.sum("__n").over(total)).drop("__n")
    return (
        ranked.join(sizes, "age_group")
        .where((F.col("__all") <= max_rows) | (F.col("__rank") <= quota))
        .drop("__rank", "__all")
    )


def graph_row(df: DataFrame) -> DataFrame:
    """Person row ready for the graph: cleaned location, default country, district key, clean lists."""
    province = F.coalesce(blank_to_null(F.col("province_cleaned")), blank_to_null(F.col("province")))
    district = F.coalesce(blank_to_null(F.col("district_cleaned")), blank_to_null(F.col("district")))
    return (
        df.withColumn("__p", province)
        .withColumn("__d", district)
        .withColumn("province", F.col("__p"))
        .withColumn("district", F.col("__d"))
        .withColumn("country", F.coalesce(blank_to_null(F.col("country")), F.lit(COUNTRY)))
        .withColumn(
            "district_key", F.when(F.col("__d").isNotNull(), F.concat_ws("-", "__p", "__d"))
        )
        .drop("__p", "__d")
    )


def property_map(columns: list[str]) -> Column:
    """Map of the properties that have a value."""
    entries = []
    for c in columns:
        entries += [F.lit(c), blank_to_null(F.col(c).cast("string"))]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


# Fixed tag per text column of a domain-tagged persona text.
DOMAIN_TAGS = {
    "professional_text": "PROF",
    "sports_text": "SPORT",
    "arts_text": "ART",
    "cultural_background": "CULT",
    "travel_text": "TRAV",
    "culinary_text": "FOOD",
    "family_text": "FAM",
}


def domain_tagged_text(available: list[str]) -> Column:
    blocks = []
    for c, tag in DOMAIN_TAGS.items():
        if c in available:
            blocks.append(F.concat(F.lit(f"[{tag}] "), blank_to_null(F.col(c))))
    return F.concat_ws(" ", *blocks)
