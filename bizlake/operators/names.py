"""Joining the text of a group into one cell, with a bound on what a cell holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import NAMES_PER_CELL
from ..session import settle
from .joins import drop_matching, join_by, keep_matching
from .order import number_rows


def _joined(df: DataFrame, keys: list[str], lists: list[str], order: list[str]) -> DataFrame:
    placed = ", ".join(f"`{c}`" for c in order)
    return df.groupBy(*keys).agg(*[
        F.expr(f"listagg(`{c}`, ';') within group (order by {placed})").alias(c) for c in lists
    ])


def join_names(
    df: DataFrame,
    key: str,
    values: dict[str, Column],
    order: list[str],
    per_cell: int = NAMES_PER_CELL,
) -> DataFrame:
    """``;``-joined values per key in the given order: key, part and a column per list.

    ``values`` names the lists and says what each takes from a row; null takes
    nothing, and all lists are made in one pass.  A key with up to ``per_cell``
    rows has one row, part 0, with everything.  A longer key continues in parts
    1, 2, ... of at most ``per_cell`` values (part 0 up to twice that), so no
    task gathers an unbounded group and no value is lost.  ``order`` must be
    unique per key.
    """
    lists = list(values)
    taken = df.select(key, *[v.alias(into) for into, v in values.items()], *order).filter(
        reduce(Column.__or__, [F.col(into).isNotNull() for into in lists])
    )
    long_keys = settle(
        taken.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > per_cell).select(key),
        "long-keys",
    )
    first_part = F.lit(0).cast("bigint")
    if long_keys.isEmpty():
        return _joined(taken, [key], lists, order).select(key, first_part.alias("part"), *lists)

    short = _joined(drop_matching(taken, long_keys, key), [key], lists, order)
    numbered = number_rows(keep_matching(taken, long_keys, key), [key, *order], "_row", start=0)
    pieces = numbered.withColumn("_piece", F.floor(F.col("_row") / per_cell).cast("bigint"))
    start = pieces.groupBy(key).agg(F.min("_piece").alias("_start"))
    parts = join_by(pieces, start, [key]).withColumn(
        "part", F.greatest(F.col("_piece") - F.col("_start") - 1, first_part)
    )
    long = _joined(parts, [key, "part"], lists, ["_row"])
    return short.select(key, first_part.alias("part"), *lists).unionByName(
        long.select(key, "part", *lists)
    )


def whole_cells(parts: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """One row per key, part 0, with all values of each list: the parts of ``join_names`` in order."""
    whole = _joined(parts, [key], lists, ["part"])
    return whole.select(key, F.lit(0).cast("bigint").alias("part"), *lists)
