"""A key that holds a third of the rows: run-time splitting applies to every join that meets one."""

import pytest
from pyspark.sql import functions as F

from shapewright.operators.filters import with_match, without_match
from shapewright.operators.joins import child_above_parent, lookup, rows_at_group_max
from shapewright.operators.numbering import dense_rank_all
from shapewright.operators.ranking import top_per_group

# thresholds small enough for a test; a cluster keeps Spark's own
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "30k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "15k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def tiny_thresholds(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture
def hot(spark):
    k = F.col("id")
    third = k % 3 == 0
    return spark.range(0, 120_000, 1, 8).select(
        k, F.when(third, 7).otherwise(k % 5003).alias("g"), F.when(third, 10**6).otherwise(k % 1009).alias("v"), F.xxhash64(k).alias("w")
    )


@pytest.fixture
def dim(spark):
    return spark.range(0, 5003, 1, 4).select(F.col("id").alias("d"), (F.col("id") * 2).alias("twice"))


JOINS = {
    "top 1": lambda df, dim: top_per_group(df, ["g"], "v"),
    "top 3": lambda df, dim: top_per_group(df, ["g"], "v", 3, "dense_rank"),
    "join back": lambda df, dim: rows_at_group_max(df, ["g"], "v"),
    "tuple in": lambda df, dim: with_match(df, df.groupBy("g").agg(F.max("v").alias("v")), ["g", "v"]),
    "rank": lambda df, dim: dense_rank_all(df, "v"),
    "lookup": lambda df, dim: lookup(df, dim, "g", "d", {"t": "twice"}),
    "exists": lambda df, dim: with_match(df, dim, {"g": "d"}),
    "not exists": lambda df, dim: without_match(df, dim.filter("d % 2 = 0"), {"g": "d"}),
    "parent": lambda df, dim: child_above_parent(df, "id", "g", "v"),
}


@pytest.mark.parametrize("name", JOINS)
def test_hot_partition_is_split(spark, tiny_thresholds, hot, dim, name):
    joined = JOINS[name](hot, dim)
    whole = joined.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*joined.columns) % 1000))
    assert whole.collect()[0][0] > 0
    assert "skew=true" in whole._jdf.queryExecution().executedPlan().toString()


def test_hot_right_side_shrinks_before_the_shuffle(spark, tiny_thresholds, hot, dim):
    plan = without_match(dim, hot, {"d": "g"})._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[g" in plan and "_copy" in plan
