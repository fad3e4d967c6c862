import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import session  # noqa: E402

from bizlake.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = tune(session())
    yield spark
    spark.stop()


@pytest.fixture
def apply(spark):
    """Values of a column expression over one text column ``x``."""

    def run(values, expression, kind="string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
        rows = df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
        return [row.y for row in rows]

    return run
