"""What the physical plans of key operators must and must not have."""

import pytest

from tesserax import plans

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = plans.QUERIES[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q_kv_find", "q_sst_point_lookup", "q_rt_window", "q_app_orders_in_area", "q_lifo_top"])
def test_no_full_sort_or_cross_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "rangepartitioning" not in text


def test_filters_reach_the_scan(spark):
    text = plan(spark, "q_kv_find")
    assert "EqualTo(o_orderkey,679)" in text and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan(spark, "q_rt_window")


@pytest.mark.parametrize("name", ["q_rt_join_overlap", "q_rt_join_closed", "q_ab_query"])
def test_spatial_joins_are_equi_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["q_kv_next", "q_kv_scan_asc", "q_mm_scan", "q_app_snapshot", "q_fs_tree"])
def test_order_over_a_table_is_partitioned(spark, name):
    """A window without a partition may only stand over the one row per bucket."""
    text = plan(spark, name)
    for window in [x for x in text.split("\n") if "Window [" in x and "_b#" not in x]:
        pytest.fail(window)


def test_top_one_is_no_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "q_pq_top") and "TakeOrderedAndProject" in plan(spark, "q_kv_lower_bound")
