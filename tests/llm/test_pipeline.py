"""The pipeline stage by stage against plain definitions, and the registered queries against their SQL."""

import os
import re
import sys

import brute
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline
import oracle_check
from popgraph.llm import quality, registered
from popgraph.llm.common import kept, numbered, prepare

SF = "/root/testdata/sf0.001"


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in numbered(docs).orderBy("__row").collect()]


def ordered(rows):
    return sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or ""))


def test_stages(spark, tmp_path):
    prepare(spark)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = kept(spark.createDataFrame(brute.documents(), brute.DOCS).select(*columns).repartition(2), "docs")
    clean = [t for _, t in pairs(docs) if t and len(brute.words(t)) > 120]
    spark.createDataFrame([(1, " ".join(brute.words(clean[0])[:60]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    judged = {(r[0], r[1]): r[2] for r in quality.judge(docs).select("doc.doc_id", "doc.text", "kept").collect()}
    first = kept(stages["quality_rules"](spark, docs, str(tmp_path)), "stage")
    assert first.columns == columns
    assert ordered(pairs(first)) == ordered([p for p in pairs(docs) if judged[p]])
    second = kept(stages["line_dedup"](spark, first, str(tmp_path)), "stage")
    before = pairs(first)
    want = [(d, t) for (d, old), t in zip(before, brute.template_lines(before)) if t == old or brute.words(t)]
    assert second.columns == columns and ordered(pairs(second)) == ordered(want)
    third = kept(stages["near_duplicates"](spark, second, str(tmp_path)), "stage")
    before = pairs(second)
    met, want = set(), []
    components = brute.jaccard_components(before, 5, 80, roots=True)
    for i in sorted(range(len(before)), key=lambda i: (before[i][0] is None, before[i][0] or 0, i)):
        if components[i][2] not in met:
            want.append(before[i])
            met.add(components[i][2])
    assert third.columns == columns and ordered(pairs(third)) == ordered(want)
    items = [(1, " ".join(brute.words(clean[0])[:60]))]
    fourth = kept(stages["decontamination"](spark, third, str(tmp_path)), "stage")
    assert ordered(pairs(fourth)) == ordered([p for p in pairs(third) if not brute.benchmark_hits(p[1], items)[4]])
    mixed = stages["mixing"](spark, fourth, str(tmp_path)).collect()
    sizes = {}
    for r in fourth.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    target = brute.targets(sizes)
    for source, want_words in target.items():
        assert abs(sum(r["n_words"] for r in mixed if r["source"] == source) - want_words) <= 128
    assert all(len(brute.words(r["text"])) == r["n_words"] for r in mixed)


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query(spark, name):
    """Every query runs on the smallest tables; those with SQL agree with it."""
    con = oracle_check.oracle(SF)
    status, rows, _, note = oracle_check.compare(spark, con, name, registered.QUERIES[name], registered.SQL.get(name), SF)
    assert status in ("ok", "rows") and rows, note


def test_names_and_local_checkpoints():
    names = [n for n in registered.QUERIES if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in registered.QUERIES
    root = os.path.dirname(os.path.abspath(registered.__file__))
    for name in os.listdir(root):
        if name.endswith(".py"):
            with open(os.path.join(root, name)) as file:
                assert "localCheckpoint" not in file.read()
