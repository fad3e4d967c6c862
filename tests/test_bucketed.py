"""Tables in buckets of a key, joined where they lie."""

import pytest
from pyspark.sql import functions as F

from bizlake.operators.joins import join_by
from bizlake.sources.sinks import SkewedKeyError, write_bucketed


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_no_exchange_between_buckets_of_one_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = spark.range(6000).select((F.col("id") % 700).cast("string").alias("cf"), F.col("id").alias("n"))
        names = spark.range(650).select(F.col("id").cast("string").alias("cf"), F.concat(F.lit("x"), "id").alias("name"))
        left, right = write_bucketed(facts, "facts", "cf", 8), write_bucketed(names, "names", "cf", 8)
        for how in ("inner", "left", "left_semi", "left_anti"):
            joined = join_by(left, right, ["cf"], how, colocated=True)
            assert "Exchange" not in _plan(joined), how
            assert sorted(map(str, joined.collect())) == sorted(map(str, join_by(facts, names, ["cf"], how).collect()))
        assert "Exchange" in _plan(join_by(left, right, ["cf"]))
        # an aggregate by the key needs none either
        assert "Exchange" not in _plan(left.groupBy("cf").agg(F.sum("n")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_key_is_refused(spark):
    hot = spark.range(9000).select(F.when(F.col("id") < 6000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("cf"))
    with pytest.raises(SkewedKeyError, match="6000 of 9000"):
        write_bucketed(hot, "hot", "cf", 8)


def test_empty_and_null_keys(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "cf string, n int")
    written = write_bucketed(rows, "rows", "cf", 4)
    assert sorted(map(str, written.collect())) == sorted(map(str, rows.collect()))
    assert write_bucketed(rows.limit(0), "none", "cf", 4).count() == 0
    assert join_by(written, written.select("cf", F.col("n").alias("m")), ["cf"], colocated=True).count() == 1
