"""Physical-plan checks: no Python in any plan, pruned scans, one exchange for the
feature windows, pushed filters."""

from __future__ import annotations

import pytest

from shelfcast.plans.catalog import QUERIES
from tests.conftest import SF_SMALL

# Their plans are behind fits; tests/test_modeling.py runs them.
MODEL_QUERIES = {"two_stage_forecast", "two_stage_forecast_monthly", "forecast_latest", "score_valid_requests"}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODEL_QUERIES))
def test_no_python_in_plan(spark, name):
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert node not in text, f"{name} plans {node}"


def test_lineitem_scan_is_pruned(spark):
    text = plan_text(QUERIES["weekly_features"](spark, SF_SMALL))
    schema = [line for line in text.splitlines() if "ReadSchema" in line and "l_orderkey" in line][0]
    assert "l_shipdate" not in schema and "l_comment" not in schema and "l_tax" not in schema


def test_feature_windows_share_one_sort(spark):
    from shelfcast.operators import features as fe
    from shelfcast.sources import fixtures

    df = fe.build_features(fixtures.transactions(spark, SF_SMALL), fe.WEEKLY, narrow=False)
    text = df._jdf.queryExecution().sparkPlan().toString()
    assert text.count("Window [") == 1


def test_time_split_filter_pushdown(spark, tmp_dir):
    import os

    from pyspark.sql import functions as F

    from shelfcast.operators.dataset import time_split
    from shelfcast.operators import features as fe
    from shelfcast.sources import fixtures
    from shelfcast.sources.sinks import write_features

    path = os.path.join(tmp_dir, "weekly")
    write_features(fe.build_features(fixtures.transactions(spark, SF_SMALL), fe.WEEKLY), path)
    feats = spark.read.parquet(path)
    train, _ = time_split(feats, "week_ending", "1996-01-01", "2001-01-01", "2002-01-01")
    text = plan_text(train.select("product_id", F.col("lag_1_week")))
    assert "PushedFilters: [IsNotNull(week_ending), GreaterThanOrEqual(week_ending" in text


def _physical(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rollup_aggregates_before_the_shuffle(spark):
    from shelfcast.operators import features as fe
    from shelfcast.sources import fixtures

    text = fe.rollup(fixtures.transactions(spark, SF_SMALL), fe.WEEKLY)._jdf.queryExecution().sparkPlan().toString()
    # Map-side partial aggregate exists: hot products shrink before they are shuffled.
    assert "partial_sum(quantity" in text and "partial_avg(unit_price" in text


def test_order_join_is_sort_merge_and_part_broadcast_only_under_threshold(spark):
    from shelfcast.sources import fixtures

    text = _physical(fixtures.transactions(spark, SF_SMALL))
    assert "SortMergeJoin" in text  # lineitem x orders: fact to fact
    assert "BroadcastHashJoin" in text  # part is small here and passes the size check
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = _physical(fixtures.transactions(spark, SF_SMALL))
        assert "BroadcastHashJoin" not in text and text.count("SortMergeJoin") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_latest_row_uses_group_limit(spark):
    from shelfcast.operators import features as fe
    from shelfcast.operators.scoring import latest_rows
    from shelfcast.sources import fixtures

    feats = fe.build_features(fixtures.transactions(spark, SF_SMALL), fe.WEEKLY, narrow=False)
    text = latest_rows(feats, fe.WEEKLY)._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in text
