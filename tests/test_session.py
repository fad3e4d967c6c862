"""The shared folder."""

import os
from types import SimpleNamespace

import pytest

from bizlake.session import fresh_path, settle, shared_dir


def stub(**settings):
    conf = SimpleNamespace(get=lambda name, default=None: settings.get(name, default))
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId="app-stub"))


def test_the_named_folder_is_used():
    named = {"spark.checkpoint.dir": "hdfs://shared/tmp/", "spark.master": "yarn"}
    assert shared_dir(stub(**named)) == "hdfs://shared/tmp"
    assert fresh_path(stub(**named), "x").startswith("hdfs://shared/tmp/bizlake/x-")


def test_a_cluster_without_a_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(stub(**{"spark.master": "yarn"}))


def test_a_local_session_gets_one_folder():
    local = stub(**{"spark.master": "local[2]"})
    assert shared_dir(local) == shared_dir(local) and os.path.isdir(shared_dir(local))


def test_settled_tables_keep_rows_and_schema(spark):
    df = spark.range(10).selectExpr("id", "cast(id as string) as `odd.name`")
    kept = settle(df)
    assert kept.columns == df.columns and kept.count() == 10


def test_the_price_is_read_once_per_order(spark, tmp_path):
    from bizlake.suite.base import Tables

    spark.sql("SELECT 1L o_orderkey, 2L o_custkey, 'P' o_orderstatus, 1234.5D o_totalprice, "
              "TIMESTAMP '1995-01-02' o_orderdate, '1-URGENT' o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    rows = Tables(spark, str(tmp_path)).fin_raw
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("cast(o_totalprice") == 1
    assert "_price" not in rows.columns
    assert rows.first().totale_attivo == "1234,50" and rows.first().totale_patrimonio_netto == "4938,00"
