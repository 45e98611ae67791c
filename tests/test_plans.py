"""What the planner makes of the queries: pushdown, pruning, no Python, no products."""

import contextlib
import io

import pytest

from slicesync.functions import periods as P
from slicesync.operators.paging import page
from slicesync.operators.slices import restrict
from slicesync.queries import QUERIES
from slicesync.queries.shared import AS_OF_PURCHASES, table
from slicesync.sources.versions import VersionedTable


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


PUSHED = ["flt1_period_range", "flt2_period_since_months", "flt3_year_range",
          "flt4_year_since_months", "flt5_timestamp_since_months", "flt6_timestamp_since_days",
          "flt7_date_range", "flt8_flag_and_time", "flt11_year_of_date", "src15_pre_count"]


@pytest.mark.parametrize("name", PUSHED)
def test_time_filters_reach_the_scan(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThanOrEqual" in pushed


LAZY = [name for name in QUERIES
        if not name.startswith(("dif", "inc", "rev", "evt1", "snk", "ver", "str", "aud1", "val"))]


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_products(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                 "ArrowEvalPython", "MapInPandas"):
        assert node not in plan


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = plan_of(QUERIES["agg13_value_frequency"](spark, sf_dir))
    assert "ReadSchema: struct<l_suppkey:bigint>" in plan


@pytest.mark.parametrize("values", [2, 2000])
def test_level1_values_prune_the_scan(spark, sf_dir, values):
    keys = [str(3 + i) for i in range(values)]
    plan = plan_of(restrict(table(spark, sf_dir, "lineitem"), "l_suppkey", keys))
    assert f"GreaterThanOrEqual(l_suppkey,3), LessThanOrEqual(l_suppkey,{values + 2})" in plan
    assert "LeftSemi" in plan


def test_parts_are_pruned_as_directories(spark, sf_dir, folder):
    versions = VersionedTable(spark, folder, partition_by="o_orderstatus")
    versions.overwrite(table(spark, sf_dir, "orders"))
    plan = plan_of(versions.read(parts=["F"]))
    assert "PartitionFilters" in plan and "o_orderstatus" in plan.split("PartitionFilters")[1]


def test_pages_keep_only_the_top_rows(spark, sf_dir):
    plan = plan_of(page(table(spark, sf_dir, "orders"), ["o_orderkey"], 10, 20))
    assert "TakeOrderedAndProject" in plan


def test_a_fingerprint_shuffles_one_row_per_slice_and_task(spark, sf_dir):
    plan = plan_of(QUERIES["agg2_level2_fingerprint"](spark, sf_dir))
    assert plan.count("Exchange") >= 1 and "partial_bit_xor" in plan and "SortAggregate" not in plan


def test_small_slices_are_broadcast_by_their_size(spark, sf_dir):
    plan = plan_of(QUERIES["join4_slice_delete"](spark, sf_dir))
    assert "BroadcastHashJoin LeftAnti" in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["join4_slice_delete"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin LeftAnti" in plan


def test_period_filter_literal(spark):
    with pytest.raises(ValueError):
        P.since_months("x", AS_OF_PURCHASES, 0)
