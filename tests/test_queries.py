"""Every registered query against its SQL on the smallest test tables."""

import pytest
from compare import compare, connect

from bizlake import suite

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query(name, spark, con):
    good, note = compare(name, spark, con, FOLDER)
    assert good, note


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
