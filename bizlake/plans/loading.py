"""Loads that readers see whole or not at all.

Tables of a load are written under its own name.  Nothing points there until
every table is written and checked; then one record is appended to the list of
published loads, which is the only thing a reader asks for the way.  A load that
fails leaves the earlier one readable, and publishing an earlier load again goes
back to it.

Rows are counted while they are written, by metrics observed in the writing
stage itself, whose tasks count once however often they are tried.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

#: Child rows carry this flag until they are written.
HAS_PARENT = "has_parent"

_PUBLISHED = "number long, load string"


class LoadError(RuntimeError):
    """A load that must not be published."""


class Load:
    """A set of tables on its way to its readers."""

    def __init__(self, spark: SparkSession, root: str, name: str | None = None):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name or uuid.uuid4().hex
        self.counts: dict[str, dict[str, int]] = {}

    def path(self, table: str) -> str:
        return f"{self.root}/loads/{self.name}/{table}"

    def add(self, table: str, rows: DataFrame) -> DataFrame:
        """Write a table, without the rows that lack their parent; returns it as written."""
        child = HAS_PARENT in rows.columns
        kept = F.col(HAS_PARENT) if child else F.lit(True)
        seen = Observation()
        observed = rows.observe(seen, F.count_if(kept).alias("loaded"), F.count_if(~kept).alias("skipped"))
        written = observed.filter(HAS_PARENT).drop(HAS_PARENT) if child else observed
        # readers open a load many times; blank and repeated cells shrink well
        written.write.option("compression", "zstd").parquet(self.path(table))
        self.counts[table] = {k: seen.get[k] for k in ("loaded", "skipped")}
        return self.spark.read.schema(written.schema).parquet(self.path(table))

    def add_all(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Write tables that do not need each other at the same time."""
        with ThreadPoolExecutor(max(len(tables), 1)) as pool:
            running = {table: pool.submit(self.add, table, rows) for table, rows in tables.items()}
            return {table: job.result() for table, job in running.items()}

    def check(self, *filled: str) -> None:
        """Stop where one of these tables is missing or has no rows."""
        lacking = [t for t in filled if not self.counts.get(t, {}).get("loaded")]
        if lacking:
            raise LoadError(f"load {self.name}: no rows in {', '.join(lacking)}")

    def report(self, *tables: str) -> DataFrame:
        """(table_name, loaded, skipped) as counted when written; reads no table."""
        rows = [(t, self.counts[t]["loaded"], self.counts[t]["skipped"]) for t in tables or self.counts]
        return self.spark.createDataFrame(rows, "table_name string, loaded long, skipped long")

    def publish(self) -> None:
        """From now on readers get this load."""
        publish(self.spark, self.root, self.name)


def publish(spark: SparkSession, root: str, load: str) -> None:
    """Append one record, in one file, that names the load."""
    last = _published(spark, root)
    row = spark.createDataFrame([(last[0] + 1 if last else 1, load)], _PUBLISHED)
    row.coalesce(1).write.mode("append").json(f"{root}/published")


def missing_path(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def _published(spark: SparkSession, root: str) -> tuple[int, str] | None:
    try:
        listed = spark.read.schema(_PUBLISHED).json(f"{root}/published")
    except AnalysisException as error:
        if missing_path(error):
            return None
        raise
    last = listed.agg(F.max(F.struct("number", "load")).alias("last")).first().last
    return (last.number, last.load) if last else None


def published_tables(spark: SparkSession, root: str, tables: list[str]) -> dict[str, DataFrame]:
    """The tables of the load published last, all of the same one."""
    last = _published(spark, root.rstrip("/"))
    if last is None:
        raise LoadError(f"nothing published under {root}")
    load = Load(spark, root, last[1])
    return {table: spark.read.parquet(load.path(table)) for table in tables}
