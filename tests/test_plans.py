"""Shapes of plans that matter at scale."""

from __future__ import annotations

import pytest

from cadastra.operators.registry import QUERIES


def plan(frame) -> str:
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["jn13_landmark_links", "jn14_poi_in_radius"])
def test_radius_join_is_an_equi_join(spark, sf_dir, name):
    # the nine neighbour offsets are the only nested loop: a literal table of nine rows
    text = plan(QUERIES[name](spark, sf_dir))
    assert "HashJoin" in text or "SortMergeJoin" in text
    assert "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["win01_best_location", "win03_latest_price", "win04_current_verification"])
def test_latest_row_limits_groups_early(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, sf_dir))


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["flt04_status_in"](spark, sf_dir))
    assert "In(o_orderstatus" in text or "PushedFilters: [In" in text or "o_orderstatus" in text.split("PushedFilters")[1]


def test_top_k_is_no_full_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES["search_budget_topk"](spark, sf_dir))


def test_anti_join(spark, sf_dir):
    assert "LeftAnti" in plan(QUERIES["jn08_without_stats"](spark, sf_dir))


def test_no_python_in_declarative_operators(spark, sf_dir):
    for name in ("jn01_read_model", "agg10_trend_quarter", "scr01_04_location_score", "vec01_cosine_topk"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "Python" not in text and "Arrow" not in text
