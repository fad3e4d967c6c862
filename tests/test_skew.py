"""A third of all rows in one key: results stay whole and the hot side is split."""

import pytest
from pyspark.sql import functions as F

from bizlake.operators import aggregates, dedup, joins, order

ROWS = 120_000

#: Sizes at which the skew rule acts, brought down to test data.
SMALL_SCALE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
}


@pytest.fixture
def hot(spark):
    for name, value in SMALL_SCALE.items():
        spark.conf.set(name, value)
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 5_000).cast("string"))
    )
    yield spark.range(ROWS, numPartitions=16).select(
        key.alias("k"), "id", F.sha2(F.col("id").cast("string"), 256).alias("text")
    )
    for name in SMALL_SCALE:
        spark.conf.unset(name)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_joins_split_the_hot_key(spark, hot):
    names = spark.range(5_000).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("n")
    ).unionByName(spark.createDataFrame([("hot", 0)], "key string, n long"))
    named = joins.look_up(hot, names, "k", "key", ["n"])
    assert "skew=true" in final_plan(named)
    assert named.count() == ROWS
    checked = joins.split_by_parent(hot, names.filter("key <> 'hot'"), "k", "key")
    assert "skew=true" in final_plan(checked)
    assert checked.filter("not has_parent").count() == ROWS // 3
    assert "skew=true" in final_plan(joins.keep_matching(hot, hot, "k"))
    assert joins.drop_matching(hot, names, "k", "key").count() == 0


def test_marking_repeated_keys_splits_the_hot_key(hot):
    marked = dedup.mark_repeated(hot, ["k"], "r")
    assert "skew=true" in final_plan(marked)
    assert marked.count() == ROWS and marked.filter("r").count() == ROWS


def test_first_row_of_a_hot_key(hot):
    first = dedup.keep_first(hot, ["k"], [F.desc("id")]).filter("k = 'hot'").collect()
    assert [r.id for r in first] == [ROWS - 3]


def test_hot_groups_are_numbered_and_counted_whole(hot):
    numbered = order.number_in_group(hot.select("k", "id"), ["k"], ["id"], "n", per_task=1_000)
    assert numbered.count() == ROWS
    third = numbered.filter("k = 'hot'")
    assert third.filter(F.col("n") != F.col("id") / 3 + 1).count() == 0
    counted = aggregates.distinct_per_group(hot, ["k"], "id", "n").filter("k = 'hot'")
    assert counted.first().n == ROWS // 3
