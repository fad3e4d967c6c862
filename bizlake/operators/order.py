"""Row numbers over a whole table, computed without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .joins import join_by

# monotonically_increasing_id() keeps the partition above bit 33
_SLOT_BITS = 33

#: Largest group one task numbers by itself.
ROWS_PER_TASK = 500_000


def _running_start(sizes: DataFrame, part: list[str], group: list[str]) -> DataFrame:
    """Rows that come before each part, from one small row per part."""
    before = Window.partitionBy(*group).orderBy(*part).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")


def number_rows(df: DataFrame, order: list[Column | str], into: str, start: int = 1) -> DataFrame:
    """Number all rows in the given order: ``start``, ``start + 1``, ...

    The table is range-partitioned on the order, so one hot leading value is
    still spread over several tasks, and written once.  The rows before each
    partition come from a table with one row per partition, which is what
    bounds the broadcast.  ``order`` must be unique for a repeatable result.
    """
    ranged = settle(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "ranged",
    )
    placed = ranged.withColumns({
        "_part": F.shiftright("_slot", _SLOT_BITS),
        "_place": F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1)),
    }).drop("_slot")
    starts = _running_start(
        placed.groupBy("_part").agg(F.count("*").alias("_n")), ["_part"], []
    )
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(into, F.col("_before") + F.col("_place") + F.lit(start).cast("bigint"))
        .drop("_part", "_place", "_before")
    )


def land(scan: DataFrame) -> DataFrame:
    """Land a file scan as a table that remembers where each row stood."""
    return settle(
        scan.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        ).withColumn("_slot", F.monotonically_increasing_id()),
        "landed",
    )


def number_in_file_order(landed: DataFrame, into: str, per_file: bool = False) -> DataFrame:
    """Number landed rows as they stood in their files, without sorting them.

    Rows of one file block are contiguous, so the number is the size of the
    earlier blocks plus the distance from the first row of the own block.
    """
    blocks = landed.groupBy("_file", "_block").agg(
        F.count("*").alias("_n"), F.min("_slot").alias("_first")
    )
    starts = _running_start(
        blocks, ["_file", "_block"], ["_file"] if per_file else []
    )
    return (
        join_by(landed, starts, ["_file", "_block"])
        .withColumn(into, F.col("_before") + F.col("_slot") - F.col("_first") + 1)
        .drop("_file", "_block", "_slot", "_first", "_before")
    )


def number_in_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    into: str,
    per_task: int = ROWS_PER_TASK,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Number the rows of every group from 1.

    Groups of up to ``per_task`` rows are numbered by a window.  Larger ones are
    range-sorted as one table and shifted by their first number, so that no
    task has to hold them.  ``keys`` hold no nulls; ``order`` must be unique
    within a group.  ``sizes`` holds the keys that tell which groups are large,
    where counting ``df`` would repeat its joins; numbers do not depend on it.
    """
    counted = df if sizes is None else sizes.select(*keys).dropna()
    large = settle(
        counted.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > per_task).select(*keys),
        "large-groups",
    )
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    if large.isEmpty():
        return df.withColumn(into, within)
    small = join_by(df, large, keys, "left_anti").withColumn(into, within)
    numbered = number_rows(join_by(df, large, keys, "left_semi"), [*keys, *order], "_at")
    first = numbered.groupBy(*keys).agg(F.min("_at").alias("_start"))
    shifted = (
        join_by(numbered, first, keys)
        .withColumn(into, F.col("_at") - F.col("_start") + 1)
        .drop("_at", "_start")
    )
    return small.unionByName(shifted)
