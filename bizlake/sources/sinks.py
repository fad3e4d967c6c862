"""Writing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import double_with_comma
from ..session import fresh_path


def write_delimited(df: DataFrame, path: str, columns: list[str] | None = None, sep: str = "|") -> None:
    """Write the columns of a layout as delimited text with a header.

    The result is a folder of part files without byte-order mark; dates are
    ``yyyy-MM-dd`` and blank or null cells are empty.
    """
    chosen = df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df
    (
        chosen.write.mode("overwrite")
        .option("sep", sep)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )


def with_decimal_commas(df: DataFrame) -> DataFrame:
    """Double columns as text with a decimal comma; other columns unchanged."""
    return df.select([
        double_with_comma(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def replace_table(df: DataFrame, table: str, path: str | None = None) -> None:
    """Full refresh of a catalogue table, kept under ``path`` where one is given."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)


class SkewedKeyError(ValueError):
    """One key holds too much of a table for buckets of that key."""


def write_bucketed(
    df: DataFrame, name: str, key: str, buckets: int, path: str | None = None, most: float = 4.0
) -> DataFrame:
    """Write a table in sorted buckets of ``key`` and return it as written.

    Tables with the same number of buckets of keys of the same type join without a
    shuffle.  All rows of a key lie in one bucket and are joined by one task, so a
    key with more rows than ``most`` times an even bucket is refused; such tables
    are joined by shuffling, where the skew-join rule splits the key.  Null keys
    count as one.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n").alias("hot"), F.sum("n").alias("rows")).first()
    if sizes.rows and sizes.hot > max(most * sizes.rows / buckets, 1_000):
        raise SkewedKeyError(f"one {key} has {sizes.hot} of {sizes.rows} rows")
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    # each bucket is written once, by the task that holds it
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path or fresh_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def write_json(df: DataFrame, path: str, if_absent: bool = False) -> None:
    """Write rows as JSON; ``if_absent`` leaves an existing target alone."""
    df.write.mode("ignore" if if_absent else "overwrite").json(path)


def layout_columns(layout: DataFrame, names: str, order: str) -> list[str]:
    """Column names of one export, in its order; rows without an order are not exported."""
    rows = layout.select(names, F.col(order).cast("double").alias("_at")).dropna().orderBy("_at")
    return [row[0] for row in rows.collect()]
