"""Scale properties of the compiled plans, kept as regression tests."""

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

TOPK = ["jaccard_topk", "tfidf_similar_topk", "text_search_topk", "similar_by_name",
        "embedding_similar_topk"]


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", TOPK + ["user_recs_join", "clean_full", "rating_parse", "seed_eligibility"])
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", TOPK)
def test_topk_uses_window_group_limit(spark, name):
    assert "WindowGroupLimit" in _plan(spark, name)


def test_cleaning_stays_in_jvm(spark):
    plan = _plan(spark, "clean_full")
    for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert node not in plan


def test_scans_are_pruned(spark):
    plan = _plan(spark, "rating_parse")
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan
    assert "l_extendedprice" not in plan and "l_comment" not in plan
