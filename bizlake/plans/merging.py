"""Carry-forward as a merge: only buckets of companies that changed are written again.

Statements lie in folders by a hash of the company.  A digest per company, kept
beside them, tells which companies of a new delivery differ from what is stored;
every other bucket is left as it is, file by file.  The statements of companies
that are no longer delivered stay.

Before buckets are replaced their numbers are logged, and again when all is
written.  After a run that broke off, the next one writes its buckets too,
whatever their digests say.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import normalise_identifier
from ..operators.joins import drop_matching, join_by
from ..session import settle
from .loading import missing_path

#: Folders of a store; the number is fixed once a store has rows.
BUCKETS = 64

_LOG = "number long, done boolean, buckets array<int>"
_DIGESTS = "_id string, n long, first_sum decimal(38,0), second_sum decimal(38,0), repeated boolean, _bucket int"


def _placed(rows: DataFrame, key: str) -> DataFrame:
    keyed = rows.withColumn("_id", normalise_identifier(F.col(key)))
    return keyed.withColumn("_bucket", F.pmod(F.xxhash64("_id"), F.lit(BUCKETS)).cast("int"))


def _digests(placed: DataFrame) -> DataFrame:
    """One row per company: its rows, two sums of their hashes, whether some are equal."""
    columns = [f"`{c}`" for c in placed.columns]
    # nulls and blanks in different columns must not hash alike
    parts = [F.col(c).isNull() for c in columns] + [F.col(c) for c in columns]
    hashed = placed.select("_id", "_bucket", F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second"), *parts).alias("b"))
    # equal rows are counted before they meet
    counted = hashed.groupBy("_id", "_bucket", "a", "b").agg(F.count("*").alias("n"))
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)") * F.col("n").cast("decimal(12,0)")).cast("decimal(38,0)")
    return counted.groupBy("_id", "_bucket").agg(
        F.sum("n").alias("n"), total("a").alias("first_sum"), total("b").alias("second_sum"), F.max(F.col("n") > 1).alias("repeated")
    ).select("_id", "n", "first_sum", "second_sum", "repeated", "_bucket")


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    reader = spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if missing_path(error):
            return spark.createDataFrame([], schema)
        raise


def _last(spark: SparkSession, root: str):
    """The record logged last, or null."""
    return _stored(spark, f"{root}/log", _LOG).agg(F.max(F.struct("number", "done", "buckets")).alias("last")).first().last


def _note(spark: SparkSession, root: str, number: int, done: bool, buckets: list[int]) -> None:
    row = spark.createDataFrame([(number, done, buckets)], _LOG)
    row.coalesce(1).write.mode("append").parquet(f"{root}/log")


def _replace(rows: DataFrame, path: str) -> None:
    """Replace the buckets that occur in ``rows``; a large one is written by several tasks."""
    spread = rows.hint("rebalance", "_bucket")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def changed_buckets(now: DataFrame, before: DataFrame) -> list[int]:
    """Buckets with a company that is new or differs, or whose kept rows have to change.

    Rows of a company that is no longer delivered are kept once each, and not
    at all where its key is blank.  At most BUCKETS numbers come back.
    """
    sums = ["n", "first_sum", "second_sum"]
    known = before.select("_id", *[F.col(c).alias(f"_{c}") for c in sums])
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_{c}") for c in sums])
    differ = join_by(now, known, ["_id"], "left").filter(~F.coalesce(same, F.lit(False)))
    gone = drop_matching(before, now, "_id").filter((F.col("_id") == "") | F.col("repeated"))
    return [r._bucket for r in differ.select("_bucket").unionByName(gone.select("_bucket")).distinct().collect()]


def merge_statements(current: DataFrame, root: str, key: str = "cf") -> list[int]:
    """Bring the store under ``root`` up to date with a delivery; returns the buckets written."""
    spark = current.sparkSession
    placed = settle(_placed(current, key), "delivery")
    stored = _stored(spark, f"{root}/rows", placed.schema)
    now = settle(_digests(placed.select(*placed.columns)), "digests")
    before = _stored(spark, f"{root}/digests", _DIGESTS)
    last = _last(spark, root)
    changed = changed_buckets(now, before)
    if last and not last.done:
        changed = list({*changed, *last.buckets})
    if not changed:
        return []
    touched = F.col("_bucket").isin(changed)
    gone = settle(drop_matching(stored.filter(touched & (F.col("_id") != "")), now, "_id").distinct(), "gone")
    # both tables are written already, and a company is in one of them only
    rows = placed.filter(touched).unionByName(gone)
    digests = settle(now.filter(touched).unionByName(_digests(gone)), "merged-digests")
    number = last.number + 1 if last else 1
    _note(spark, root, number, False, changed)
    _clear_empty(spark, root, digests, changed, placed.schema)
    _replace(rows, f"{root}/rows")
    _replace(digests, f"{root}/digests")
    _note(spark, root, number, True, [])
    return sorted(changed)


def _clear_empty(spark: SparkSession, root: str, digests: DataFrame, changed: list[int], schema) -> None:
    """A bucket left without companies gets a file without rows, as nothing else replaces it."""
    filled = {r._bucket for r in digests.select("_bucket").distinct().collect()}
    for bucket in sorted(set(changed) - filled):
        for name, kind in (("rows", schema), ("digests", _stored(spark, f"{root}/none", _DIGESTS).schema)):
            empty = spark.createDataFrame([], kind).drop("_bucket")
            empty.write.mode("overwrite").parquet(f"{root}/{name}/_bucket={bucket}")


def statements(spark: SparkSession, root: str, schema) -> DataFrame:
    """All statements of the store, with the columns of ``schema``."""
    return spark.read.parquet(f"{root}/rows").select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])
