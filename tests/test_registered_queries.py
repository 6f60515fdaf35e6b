"""Registered plans against their SQL on the smallest tables; tests/oracle_check.py runs all of them."""

import os

import pytest

import __spark_entry__ as entry
import oracle_check
import popgraph
from popgraph.plans.registry import PLANS

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "IO05_context_csv", "PP04_preprocess", "PP16_split_items", "GM02_edges", "FL06_occupation", "AG10_overview", "AG14_compare_segments",
    "SR01_faceted_search", "CT04_adjacent_occupations", "LM03_keyword_overlap", "SG03_ego_depth3", "PT01_shortest_path", "RG01_recommend_hobby",
    "GA10_largest_component", "GA09_k_hop", "VE01_stored_index", "CP19_unknown_person_fallback", "RD10_split", "RD12_sample_negative", "CP06_segment_popularity", "CP14_jaccard", "SC03_merge", "RF14_feature_vector",
    "ME09_ranking_metrics", "AU03_average_rank", "EX02_reasons", "TX03_suffix_mining", "TL07_near_duplicate_texts", "CH01_intents", "CH04_carried_filters",
    "RK12_final_recommendations", "ST02_upsert_stream",
]


@pytest.fixture(scope="module")
def con():
    return oracle_check.oracle(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_plan_equals_sql(spark, tables, con, name):
    sql = entry.oracle_sql()[name]
    status, _, _, note = oracle_check.compare(spark, con, name, lambda s, d: PLANS[name](tables), sql, SF)
    assert status == "ok", f"{status} {note}"


def test_registry_is_complete():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and entry.FLAGSHIP in names


def test_no_single_copy_checkpoints():
    root = os.path.dirname(os.path.abspath(popgraph.__file__))
    for folder, _, files in os.walk(root):
        for file in files:
            if file.endswith(".py"):
                with open(os.path.join(folder, file)) as source:
                    assert "localCheckpoint" not in source.read(), file
