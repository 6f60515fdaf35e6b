"""Readers and writers of persona tables, edge and context files, JSON vocabularies and snapshots."""

from __future__ import annotations

import uuid as uuidlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popgraph.functions.columns import blank_to_null
from popgraph.schema import CONTEXT_COLUMNS, RAW_PERSONA_COLUMNS, RAW_PERSONA_SCHEMA, require_columns
from popgraph.session import ensure_checkpoint_dir

EDGE_COLUMNS = ["person_uuid", "hobby_name"]
BOM = "﻿"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, visible to every executor."""
    return f"{ensure_checkpoint_dir(spark)}/popgraph-{name}-{uuidlib.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again. A checkpoint would keep the constraints of the plans before it, and
    their number grows with every round of a loop."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_personas(spark: SparkSession, parquet: str | None, csv: str | None = None, rows: int | None = None) -> DataFrame:
    """Raw persona table from parquet if given, else csv; `rows` keeps the first rows by uuid."""
    if parquet:
        df = spark.read.parquet(parquet)
    elif csv:
        df = spark.read.schema(RAW_PERSONA_SCHEMA).csv(csv, header=True, multiLine=True, escape='"', mode="FAILFAST")
    else:
        raise FileNotFoundError("no persona table given")
    df = require_columns(df, RAW_PERSONA_COLUMNS).select(*RAW_PERSONA_COLUMNS)
    return df if rows is None else df.orderBy("uuid").limit(rows)


def _read_exact_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    header = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = [header.columns[0].removeprefix(BOM), *header.columns[1:]] if header.columns else []
    if names != columns:
        raise ValueError(f"expected header {','.join(columns)} but found {','.join(names)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True, multiLine=True, escape='"')


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """person_uuid, hobby_name: trimmed, blanks dropped, each pair once; fails when nothing remains."""
    df = _read_exact_csv(spark, path, EDGE_COLUMNS)
    out = df.select(*[blank_to_null(F.col(c)).alias(c) for c in EDGE_COLUMNS]).dropna().distinct()
    if out.isEmpty():
        raise ValueError("no person-item edges found")
    return out


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """21 context columns, trimmed, nulls blank; a person's last row in the order of file names wins."""
    df = _read_exact_csv(spark, path, CONTEXT_COLUMNS)
    rows = df.select(
        *[F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) for c in CONTEXT_COLUMNS],
        F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("__pos"),
    ).where(F.col("person_uuid") != "")
    return last_row_wins(rows, "person_uuid", "__pos").drop("__pos")


def last_row_wins(df: DataFrame, key: str, position: str) -> DataFrame:
    """Keep each key's last row; max_by combines in every task before the shuffle."""
    others = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*others), F.col(position)).alias("__last")
    return df.groupBy(key).agg(last).select(key, "__last.*")


def write_split(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def read_alias_map(spark: SparkSession, path: str) -> DataFrame:
    """raw -> canonical pairs of a JSON object; blank or conflicting entries are rejected."""
    text = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "map<string,string>")).alias("raw", "canonical")
    )
    return check_aliases(text)


def check_aliases(pairs: DataFrame) -> DataFrame:
    norm = [F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))).alias(c) for c in ("raw", "canonical")]
    out = pairs.select(*norm).distinct()
    bad = out.groupBy("raw").agg(
        F.count_distinct("canonical").alias("targets"), F.min("canonical").alias("lowest")
    ).where((F.col("raw") == "") | (F.col("lowest") == "") | (F.col("targets") > 1))
    found = [r["raw"] for r in bad.limit(5).collect()]
    if found:
        raise ValueError(f"blank or conflicting aliases: {found}")
    return out


RULE_TYPE = (
    "array<struct<canonical_hobby:string,include_keywords:array<string>,exclude_keywords:array<string>,"
    "taxonomy:struct<category:string,subcategory:string,intensity:string,sociality:string,location_sensitive:boolean>>>"
)
TAXONOMY_SCHEMA = (
    f"rules {RULE_TYPE}, aliases map<string,string>, manual_aliases map<string,string>, "
    "taxonomy map<string,struct<category:string,subcategory:string,intensity:string,sociality:string,"
    "location_sensitive:boolean>>, display_examples map<string,array<string>>"
)
REVIEW_SCHEMA = (
    f"approved_clusters {RULE_TYPE}, manual_aliases map<string,string>, "
    "rejected_patterns array<string>, split_required array<string>"
)


def read_taxonomy(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Rules in file order, merged aliases and the category of each canonical name."""
    doc = spark.read.schema(TAXONOMY_SCHEMA).json(path, multiLine=True, mode="FAILFAST")
    return taxonomy_tables(doc, "rules")


def taxonomy_tables(doc: DataFrame, rules_field: str) -> dict[str, DataFrame]:
    rules = doc.select(F.posexplode(rules_field).alias("rule_ord", "r")).select(
        "rule_ord",
        F.trim("r.canonical_hobby").alias("canonical"),
        F.coalesce("r.include_keywords", F.array().cast("array<string>")).alias("include"),
        F.coalesce("r.exclude_keywords", F.array().cast("array<string>")).alias("exclude"),
        F.col("r.taxonomy.category").alias("category"),
    )
    if not rules.where((F.col("canonical") == "") | F.col("canonical").isNull() | (F.size("include") == 0)).isEmpty():
        raise ValueError("every rule needs a canonical name and include keywords")
    sources = [c for c in ("aliases", "manual_aliases") if c in doc.columns]
    aliases = None
    for rank, c in enumerate(sources):
        part = doc.select(F.explode(c).alias("raw", "canonical")).withColumn("rank", F.lit(rank))
        aliases = part if aliases is None else aliases.unionByName(part)
    aliases = aliases.groupBy("raw").agg(F.max_by("canonical", "rank").alias("canonical"))
    out = {"rules": rules, "aliases": aliases}
    if "taxonomy" in doc.columns:
        out["categories"] = doc.select(F.explode("taxonomy").alias("item", "t")).select("item", "t.category")
        out["examples"] = doc.select(F.explode("display_examples").alias("item", "examples"))
    return out


def read_review(spark: SparkSession, path: str | None) -> dict[str, DataFrame]:
    """Review decisions; a missing file means no decisions."""
    doc = (
        spark.read.schema(REVIEW_SCHEMA).json(path, multiLine=True, mode="FAILFAST")
        if path
        else spark.createDataFrame([], T._parse_datatype_string(REVIEW_SCHEMA))
    )
    out = taxonomy_tables(doc, "approved_clusters")
    out["rejected"] = doc.select(F.explode("rejected_patterns").alias("pattern"))
    out["split_required"] = doc.select(F.explode("split_required").alias("pattern"))
    return out


def upsert(old: DataFrame, new: DataFrame, key: str = "uuid") -> DataFrame:
    """Create rows that are absent and overwrite only the properties the new rows supply."""
    columns = [c for c in old.columns if c != key]
    extra = [c for c in new.columns if c != key and c not in old.columns]
    n = new.select(key, *[F.col(c).alias(f"__new_{c}") for c in new.columns if c != key])
    merged = old.join(n, key, "full_outer")
    return merged.select(
        key,
        *[(F.coalesce(f"__new_{c}", c) if c in new.columns else F.col(c)).alias(c) for c in columns],
        *[F.col(f"__new_{c}").alias(c) for c in extra],
    )


def upsert_latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Newest value of every property, whatever the order rows come in: each property is a struct that starts with the
    number of the event that set it."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(*[F.max(c).alias(c) for c in both.columns if c != key])


def only_new(new: DataFrame, existing: DataFrame, key: str = "uuid") -> DataFrame:
    return new.join(existing.select(key), key, "left_anti")


def attach_vectors(persons: DataFrame, vectors: DataFrame, strict: bool = False) -> DataFrame:
    """Persons with their vector; `strict` fails unless there is one vector per person."""
    if strict and persons.count() != vectors.count():
        raise ValueError("number of vectors differs from number of persons")
    return persons.join(vectors.select("uuid", "embedding"), "uuid", "left")


def replace_snapshot(df: DataFrame, path: str) -> int:
    """Empty a snapshot table and return how many rows it had."""
    rows = df.count()
    df.limit(0).write.mode("overwrite").parquet(path)
    return rows


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def preview(df: DataFrame, rows: int = 2) -> DataFrame:
    """Row count, columns and the first rows of a table as (part, position, value)."""
    key = df.columns[0]
    count = df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        F.lit("rows").alias("part"), F.lit(0).alias("position"), "value"
    )
    names = count.sparkSession.createDataFrame(
        [("column", i, c) for i, c in enumerate(df.columns)], "part string, position int, value string"
    )
    head = df.orderBy(key).limit(rows)
    head = head.select(
        F.lit("head").alias("part"),
        (F.row_number().over(Window.orderBy(key)) - 1).alias("position"),
        F.col(key).cast("string").alias("value"),
    )
    return count.unionByName(names).unionByName(head)
