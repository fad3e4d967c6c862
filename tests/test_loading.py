"""Loads seen whole or not at all, and counts taken while writing."""

import uuid

import pytest
from pyspark.sql import functions as F

from bizlake.operators.joins import ROWS_SENT
from bizlake.plans import loading, serving
from bizlake.suite.base import Tables
from test_plans import sources  # noqa: F401


def _jobs(spark, run):
    """Spark jobs that ``run`` starts."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        result = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def _served(spark, root):
    found = loading.published_tables(spark, root, serving.TABLES)
    return {name: sorted(map(str, df.collect())) for name, df in found.items()}


def test_a_load_is_published_whole(spark, sources, tmp_path):  # noqa: F811
    root = str(tmp_path)
    load = serving.load_serving(sources, root)
    with pytest.raises(loading.LoadError, match="nothing published"):
        loading.published_tables(spark, root, serving.TABLES)
    load.publish()
    found = loading.published_tables(spark, root, serving.TABLES)
    plans = serving.build_serving(sources)
    for name, df in found.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, plans[name].select(df.columns).collect())), name
        assert df.count() == load.counts[name]["loaded"], name
        assert "has_parent" not in df.columns


def test_counts_need_no_job_of_their_own(spark, sources, tmp_path):  # noqa: F811
    load = serving.load_serving(sources, str(tmp_path))
    report = load.report("financial", "organization", "topics")
    assert [tuple(r) for r in report.collect()] == [("financial", 3, 2), ("organization", 4, 1), ("topics", 2, 1)]
    assert "FileScan" not in report._jdf.queryExecution().toString() and not report.inputFiles()
    rows = spark.range(1000).repartition(4)
    assert _jobs(spark, lambda: load.add("once", rows))[1] == _jobs(spark, lambda: rows.write.parquet(str(tmp_path / "plain")))[1]
    assert load.counts["once"] == {"loaded": 1000, "skipped": 0}


def test_a_failing_load_leaves_the_one_before(spark, sources, tmp_path):  # noqa: F811
    root = str(tmp_path)
    serving.load_serving(sources, root).publish()
    before = _served(spark, root)
    broken = sources["organization"].withColumn("name", F.raise_error(F.lit("unreadable")).cast("string"))
    changed = sources["headquarters"].withColumn("prov", F.lit("XX"))
    with pytest.raises(Exception, match="unreadable"):
        serving.load_serving({**sources, "headquarters": changed, "organization": broken}, root).publish()
    assert _served(spark, root) == before
    empty = serving.load_serving({**sources, "project": sources["project"].limit(0)}, root)
    with pytest.raises(loading.LoadError, match="no rows in project"):
        empty.check("headquarters", "project")
    assert _served(spark, root) == before


def test_going_back_to_an_earlier_load(spark, sources, tmp_path):  # noqa: F811
    root = str(tmp_path)
    first = serving.load_serving(sources, root)
    first.publish()
    before = _served(spark, root)
    changed = sources["headquarters"].withColumn("prov", F.lit("XX"))
    serving.load_serving({**sources, "headquarters": changed}, root).publish()
    assert _served(spark, root) != before
    loading.publish(spark, root, first.name)
    assert _served(spark, root) == before


def test_empty_children_and_counts(spark, sources, tmp_path):  # noqa: F811
    load = serving.load_serving({**sources, "topics": sources["topics"].limit(0)}, str(tmp_path))
    assert load.counts["topics"] == {"loaded": 0, "skipped": 0}
    load.publish()
    assert loading.published_tables(spark, str(tmp_path), ["topics"])["topics"].count() == 0


def test_tables_of_a_load_are_written_compactly(spark, tmp_path):
    load = loading.Load(spark, str(tmp_path))
    assert load.add("t", spark.range(5)).count() == 5
    assert {p.name.split(".", 1)[1] for p in (tmp_path / "loads").rglob("part-*.parquet")} == {"zstd.parquet"}


def test_keys_of_many_parents_are_not_sent_to_all_tasks(spark, tmp_path, monkeypatch):
    """Wide tables with few filled columns look small to Spark, which goes by their files."""
    ids = spark.range(ROWS_SENT + 1).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("row_id"))
    few = spark.createDataFrame([("7",), ("none",), (" 7 ",), (None,)], "key string")
    sources = {
        "headquarters": ids.withColumnRenamed("key", "cf"), "project": ids.withColumnRenamed("key", "projectID"),
        "financial": few.withColumnRenamed("key", "cf"),
        **{name: few.withColumnRenamed("key", "projectID") for name in ("organization", "topics")},
    }
    plans, add = {}, loading.Load.add

    def watched(load, table, rows):
        plans[table] = rows._jdf.queryExecution().executedPlan().toString()
        return add(load, table, rows)

    monkeypatch.setattr(loading.Load, "add", watched)
    children = ["financial", "organization", "topics"]
    load = serving.load_serving(sources, str(tmp_path), tables=children)
    for table in children:
        assert "SortMergeJoin" in plans[table] and "Broadcast" not in plans[table], table
        assert load.counts[table] == {"loaded": 2, "skipped": 2}, table


def test_a_growing_table_of_a_binding_is_not_sent_to_all_tasks(spark, tmp_path):
    lines = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double"
    spark.createDataFrame([(1, 1, 5, 1, 1.0), (2, 1, -1, 1, 1.0)], lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    part = spark.range(ROWS_SENT + 1).select(F.col("id").alias("p_partkey"), *[F.lit("x").alias(c) for c in ("p_name", "p_brand", "p_type")])
    part.write.parquet(f"{tmp_path}/part.parquet")
    topics = Tables(spark, str(tmp_path)).voc
    assert "BroadcastHashJoin" not in topics._jdf.queryExecution().executedPlan().toString()
    assert [row.euroSciVocPath for row in topics.collect()] == ["/x/x/x"]
