"""Inputs on which an earlier form of an operator did less than its whole job."""

import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from popgraph.llm import registered
from popgraph.llm import lines, mixing, secrets
from popgraph.llm.common import kept, numbered, prepare


@pytest.fixture
def parallelism(spark):
    """Sets the parallelism of scans, as executors that register later would; ends with the default."""
    key = "spark.sql.leafNodeDefaultParallelism"
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.unset(key)


def table_of_files(spark, files):
    prepare(spark)
    rows = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"),
        F.concat_ws(" ", *(F.concat(F.lit(f"w{i}x"), F.col("id")) for i in range(40))).alias("text"),
    )
    return kept(rows.repartition(files, "doc_id"), "some docs")  # a path with a blank


@pytest.mark.parametrize("files", [1, 6])
def test_numbers_do_not_depend_on_the_splits(spark, parallelism, files):
    docs, found = table_of_files(spark, files), []
    for n, split in ((1, "128m"), (2, "128m"), (6, "64k"), (3, "20k")):
        parallelism(n)
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got = numbered(docs.select("doc_id", F.struct("*").alias("doc"))).select("doc_id", "__row").collect()
        found.append({r[0]: r[1] for r in got})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(set(found[0].values())) == docs.count() == len(found[0])
    assert all(f == found[0] for f in found)
    assert numbered(docs).columns == [*docs.columns, "__row"]


def test_mix_gets_its_own_texts_when_executors_register_late(spark, parallelism):
    docs = table_of_files(spark, 6)
    parallelism(1)
    mixed, _ = mixing.mix(docs)
    mixed = kept(mixed, "mixed")
    parallelism(6)
    texts = mixing.materialise(mixed, docs).collect()
    assert len(texts) == mixed.count()
    assert all(w.endswith(f"x{r['doc_id']}") for r in texts for w in r["text"].split(" "))


def test_letters_before_another_end_take_no_time():
    code = "from popgraph.llm.secrets import excluded; print(excluded('a' * 60 + '1'), excluded('Abcc' * 3000 + '1'), excluded('getLongNameForThisThing'))"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=20)
    assert run.stdout.split() == ["False", "False", "True"]


def test_random_letters_of_one_case_are_found(spark):
    texts = {
        "key is qxzjvkwbnmrtplghfdsc ok": "tokens:7:27", "key is QXZJVKWBNMRTPLGHFDSC ok": "tokens:7:27",
        "key is Qxzjvkwbnmrtplghfdsc ok": "tokens:7:27", "key is my_qxzjvkwbnmrtplghfdsc ok": "tokens:7:30",
        "some internationalizations and INTERNATIONALIZATION": "", "hahahahahahahahahahahaha": "",
    }
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r[0]: r[1] for r in secrets.scan_secrets(frame).select("doc.text", "spans").collect()}
    assert found == texts


def test_tokens_of_a_hot_leaf_are_not_gathered(spark, monkeypatch):
    prepare(spark)
    plans = []

    def spied(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, name)

    text = F.concat(F.lit("a b c d "), F.concat(F.lit("w"), F.translate((F.col("id") % 40).cast("string"), "0123456789", "qrstuvwxyz")), F.lit(" end"))
    docs = kept(spark.range(800).select(F.col("id").alias("doc_id"), text.alias("text")), "docs")
    monkeypatch.setattr(lines, "kept", spied)
    cut = lines.drop_template_lines(docs).select("doc.doc_id", "n_dropped").collect()
    assert {r[0] for r in cut if not r[1]} == set(range(40)) and len(cut) == 800
    assert plans and not any(re.search(r"Aggregate \[leaf#\w+\], .*collect_list", p) for p in plans)


def test_mix_counts_words_in_one_pass(spark, tmp_path, monkeypatch):
    from popgraph.llm import mixing

    calls = []
    count = mixing.text_words
    monkeypatch.setattr(mixing, "text_words", lambda *a: calls.append(a) or count(*a))
    rows = [(i, "ab"[i % 2], "w " * (i + 1)) for i in range(40)] + [(None, None, None), (3, "a", "w")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["source"], r["size"]) for r in registered.QUERIES["op6_mixing"](spark, str(tmp_path)).collect()}
    assert got == {(i, s, len((t or "").split())) for i, s, t in rows} and len(calls) == 1
