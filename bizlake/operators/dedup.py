"""Keeping one row per key, and marking repeated keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import join_by


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key in the given order.

    The rank filter lets Spark cut every key to ``n`` rows inside each input
    partition before the shuffle, so a hot key arrives already small.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def rank_within(
    df: DataFrame, keys: list[str], order: list[Column | str], n: int, into: str
) -> DataFrame:
    """As :func:`keep_first`, with the rank kept in ``into``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(into, place).filter(F.col(into) <= n)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def mark_repeated(
    df: DataFrame, keys: list[str], into: str, counted: DataFrame | None = None,
    repeated: DataFrame | None = None,
) -> DataFrame:
    """Flag every member of a repeated key.

    Counts are combined before the shuffle and joined back, so no task has to
    hold a whole group.  ``counted`` is a table to count in place of ``df``,
    for a cheaper one with the same groups; ``repeated`` holds the repeated keys
    themselves.  Where they are settled, Spark knows their size before it
    shuffles ``df``, and needs no shuffle if they are few.
    """
    if repeated is None:
        repeated = repeated_keys(df if counted is None else counted, keys)
    marked = repeated.select(*keys, F.lit(True).alias(into))
    return join_by(df, marked, keys, "left", null_is_value=True).withColumn(
        into, F.coalesce(F.col(into), F.lit(False))
    )


def drop_repeated_when(
    df: DataFrame, keys: list[str], condition: Column, counted: DataFrame | None = None,
    repeated: DataFrame | None = None,
) -> DataFrame:
    """Drop members of repeated keys that meet ``condition``; others stay."""
    return (
        mark_repeated(df, keys, "_repeated", counted, repeated)
        .filter(~(F.col("_repeated") & F.coalesce(condition, F.lit(False))))
        .drop("_repeated")
    )
