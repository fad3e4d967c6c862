"""Shares, running offsets and bar widths of a small ranked report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def width_of(value: Column, largest: Column) -> Column:
    """Percentage of the largest value, one decimal; 0 where the largest is 0."""
    return F.when(largest != 0, F.round(value / largest * 100, 1)).otherwise(F.lit(0.0))


def add_widths(df: DataFrame, widths: dict[str, str]) -> DataFrame:
    """Scale columns to the largest value of all of them: {column: width column}.

    The largest value is a scalar subquery: partial maxima, then one number.
    """
    columns = list(widths)
    top = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    largest = df.select(F.max(top)).scalar()
    return df.withColumns({into: width_of(F.col(c), largest) for c, into in widths.items()})


def top_rows(df: DataFrame, order: list[Column | str], n: int, into: str = "rank") -> DataFrame:
    """The ``n`` first rows with their rank; partitions are cut to ``n`` before they meet."""
    limited = df.orderBy(*order).limit(n)
    return limited.withColumn(into, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def widths_of_shown(shown: DataFrame, widths: dict[str, str]) -> DataFrame:
    """As :func:`add_widths` for an already limited report of a few rows."""
    columns = list(widths)
    top = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    largest = F.max(top).over(Window.partitionBy())
    return shown.withColumns({into: width_of(F.col(c), largest) for c, into in widths.items()})


def shares_of_shown(shown: DataFrame, count: str, rank: str = "rank") -> DataFrame:
    """Share of each shown row in the shown total, and where its slice starts and ends.

    The total covers the rows shown, not the whole table; rows are few.
    """
    everything = Window.partitionBy()
    so_far = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(count).over(everything)
    shared = shown.withColumn(
        "pct_of_shown", F.round(F.col(count) / F.greatest(total, F.lit(1)) * 100, 1)
    )
    end = F.round(F.sum("pct_of_shown").over(so_far), 1)
    return shared.withColumn("slice_end", end).withColumn(
        "slice_start", F.round(F.col("slice_end") - F.col("pct_of_shown"), 1)
    )
