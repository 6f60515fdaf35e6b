"""Queries opN_<name>: each operator over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popgraph.llm import align, bond, chat, ctw, decontaminate, idfile, jaccard, lines, mixing, quality, secrets, spans, sql, suffix
from popgraph.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if check:
            SQL[name] = check
        return fn

    return add


@query("op1_secrets")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, hide=("text",))
    return found.select(
        "doc.doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random"
    )


@query("op2_spans")
def op2(spark, sf_dir):
    cut = spans.drop_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc.doc_id", "n_sentences", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.col("kept_text").alias("text"))


@query("op3_suffix", sql.SUFFIX)
def op3(spark, sf_dir):
    cut = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return cut.select(
        "doc.doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op4_lines", sql.LINES)
def op4(spark, sf_dir):
    cut = lines.drop_template_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc.doc_id", "n_lines", "n_dropped", F.col("kept_text").alias("text"))


@query("op5_jaccard", sql.JACCARD)
def op5(spark, sf_dir):
    joined = jaccard.join_sets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "is_first")


@query("op6_mixing")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sizes = mixing.sized(docs)
    mixed, targets = mixing.mix(docs, sizes=sizes)
    rows = sizes.select("__row", "doc_id", F.col("source").alias("__source"), "size")
    taken = mixed.groupBy("row").agg(F.sum("n_words").alias("taken"))
    own = rows.join(F.broadcast(targets), rows["__source"].eqNullSafe(targets["source"]))
    return own.join(taken, own["__row"] == taken["row"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"
    )


@query("op7_quality")
def op7(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), carry=["doc_id"])
    return judged.select("doc.doc_id", *(c for c in judged.columns if c not in ("row", "doc")))


@query("op8_decontaminate", sql.DECONTAMINATE)
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


@query("op9_ctw")
def op9(spark, sf_dir):
    scored = ctw.score(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"], depth=ctw.DEPTH)
    return scored.select("doc.doc_id", *(c for c in scored.columns if c != "doc"))


CONTROL = r"([<\[])(\\*)(sys>|/sys>|INST\]|/INST\]|s>|/s>|/role>|role [^<>\[\]]*>)"


@query("op10_chat", rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, length(regexp_replace(text, '{CONTROL}', '\1\2\\\3', 'g'))
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 END AS chars,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'start') || '>' || role AS step,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS is_last
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(step IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user'))
    AND bool_and(role = 'assistant' OR NOT is_last) AS valid
FROM s GROUP BY conv_id
""")
def op10(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    return chat.read_back(chat.format_chat(turns.unionByName(extra)))


@query("op11_idfile")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = idfile.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op12_align")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned, _ = align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return aligned.select("doc.doc_id", *(c for c in aligned.columns if c != "doc"))


@query("op13_bond", sql.NEGATIVES)
def op13(spark, sf_dir):
    vectors, own = table(spark, sf_dir, "embeddings"), F.col("label")
    label = F.when(F.col("vec_id") % 7 == 0, (own + 1) % 10).otherwise(own)
    return bond.mine(vectors, "vec_id", "embedding", label, F.col("vec_id") % 100 == 0).drop("anchor")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
