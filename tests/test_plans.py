"""The physical plans: nothing that needs one task, a product of tables or Python per row."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry
from shapewright.operators.numbering import dense_rank_all
from shapewright.operators.ranking import latest_per_key, top_per_group, top_rows
from shapewright.plans.all_queries import ORACLES, QUERIES
from shapewright.plans.capacity import range_partitions
from shapewright.sources.tables import scan

WITH_PYTHON = {"blob_round_trip"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_bad_operators(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in WITH_PYTHON:
        assert "EvalPython" not in plan and "InPandas" not in plan and "InArrow" not in plan
    # only the starts of the slices, one row each, may be summed in one partition
    for before, after in zip(plan.split("Exchange SinglePartition"), plan.split("Exchange SinglePartition")[1:]):
        above = before.rstrip().splitlines()[-2:]
        assert not any("Window" in line for line in above) or "_slice" in "".join(above)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["n_name", "c_name", "o_orderkey", "o_totalprice"] and df.count() > 0


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_pushdown_and_pruning(spark, small):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = plan_of(QUERIES["filters"](spark, small))
    assert "GreaterThanOrEqual(o_orderdate,2001-06-02T00:00)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan
    assert "o_custkey" not in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_group_limits_come_before_the_shuffle(spark, small):
    orders = scan(spark, small, "orders")
    for df in (
        latest_per_key(orders, ["o_custkey"], F.col("o_orderkey").desc()),
        top_per_group(orders, ["o_custkey"], "o_totalprice", 3, "dense_rank"),
    ):
        limit = plan_of(df).split("WindowGroupLimit")
        assert "Exchange hashpartitioning" in limit[1] and limit[2].split("\n")[0].endswith("Partial")


def test_a_deep_page_moves_only_the_first_rows_of_each_task(spark, small):
    plan = plan_of(top_rows(scan(spark, small, "orders"), "o_orderkey", 10_000))
    assert "rangepartitioning" not in plan
    scanned = plan.split("Exchange RoundRobin")[-1].split("Exchange hashpartitioning")[-1]
    assert scanned.index("Filter") < scanned.index("Sort") < scanned.index("Scan")  # cut where the rows are


def test_numbering_reads_only_what_it_needs(spark, small):
    plan = plan_of(dense_rank_all(scan(spark, small, "customer").select("c_custkey", "c_acctbal"), "c_acctbal"))
    assert "ReadSchema: struct<_at:bigint>" in plan


def test_ranges_join_on_their_number(spark, small):
    plan = plan_of(range_partitions(scan(spark, small, "orders"), "o_orderkey", every=100))
    assert "NestedLoop" not in plan and "LeftOuter" in plan
