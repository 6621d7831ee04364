"""Physical-plan properties: pruning and pushdown reach the Parquet scan, and the
headline plans contain no cartesian / nested-loop joins."""

import pytest

from quarry.plans.registry import queries

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_call_log_prunes_and_pushes(spark):
    plan = _plan(queries()["g25_urgent_top_crops"](spark, SF))
    assert "o_orderpriority" in plan and "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)" in plan
    # lineitem is read for its join keys only
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
    g1 = _plan(queries()["g1_crop_sizes"](spark, SF))
    assert "orders" not in g1  # Crop needs part only: the orders join is not planned
    assert "ReadSchema: struct<l_partkey:bigint>" in g1


@pytest.mark.parametrize("name", ["saturation_curve", "saturation_metadata", "g13_district_crop_matrix",
                                  "w3_cluster_matrix", "s4_run_log_summary", "m1_tfidf_weights",
                                  "x3_eps_neighbours", "e_volume_scores"])
def test_no_cartesian_products(spark, name):
    plan = _plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
