"""Joins by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def join_by(
    left: DataFrame, right: DataFrame, keys: dict[str, str] | list[str], how: str = "inner",
    null_is_value: bool = False, colocated: bool = False,
) -> DataFrame:
    """Equi-join that keeps the columns of ``left`` and adds the other ones of ``right``.

    ``keys`` names the key columns, or maps those of ``left`` to those of
    ``right``.  ``null_is_value`` lets null match null.

    The join also compares a hash of the key.  The result is the same, but
    Spark then shuffles both sides for this join, even a side that an
    aggregate has already partitioned by the key; only then can the skew-join
    rule split a hot key of the other side.  The side shuffled once more is the
    aggregated one.  ``colocated`` leaves the hash out, for tables that lie in
    buckets of the key and need no shuffle at all.
    """
    pairs = keys if isinstance(keys, dict) else {k: k for k in keys}
    types = {f.name: f.dataType for f in left.schema}
    others = [F.col(f"`{c}`") for c in right.columns if c not in pairs.values()]
    slim = right.select(
        *[F.col(r).cast(types[k]).alias(f"_r_{k}") for k, r in pairs.items()], *others
    )
    hashed = slim if colocated else slim.withColumn("_r_hash", F.hash(*[f"_r_{k}" for k in pairs]))
    same = [
        F.col(k).eqNullSafe(F.col(f"_r_{k}")) if null_is_value else F.col(k) == F.col(f"_r_{k}")
        for k in pairs
    ]
    if not colocated:
        same.append(F.hash(*pairs) == F.col("_r_hash"))
    condition = reduce(Column.__and__, same)
    return left.join(hashed, condition, how).drop(*[f"_r_{k}" for k in pairs], "_r_hash")


def key_set(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Distinct keys: repeated ones collapse before the shuffle."""
    return df.select(*keys).distinct()


def keep_matching(df: DataFrame, keys: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """Rows whose ``on`` occurs in the ``key`` column of ``keys``."""
    return join_by(df, key_set(keys, key or on), {on: key or on}, "left_semi")


def drop_matching(df: DataFrame, keys: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """Rows whose ``on`` does not occur in ``keys``; null keys stay."""
    return join_by(df, key_set(keys, key or on), {on: key or on}, "left_anti")


def look_up(
    df: DataFrame, dimension: DataFrame, on: str, key: str, columns: list[str]
) -> DataFrame:
    """Left join to a dimension with unique ``key``, adding ``columns``.

    Spark broadcasts the dimension when its measured size allows it.
    """
    return join_by(df, dimension.select(key, *columns), {on: key}, "left")


#: Rows that may be sent to all tasks where their number is known.
ROWS_SENT = 100_000


def never_sent(df: DataFrame) -> DataFrame:
    """A side that joins by shuffling, however small Spark takes it to be.

    Before it runs, Spark takes a table read from files to be as large as these, and
    some of its columns to be their share by type: a key of a wide table that is mostly
    blank is up to a hundred times as large in memory.
    """
    return df.hint("merge")


def split_by_parent(
    child: DataFrame, parent: DataFrame, on: str, parent_key: str | None = None, many: bool = False
) -> DataFrame:
    """Child rows with ``has_parent``, from one pass over the child; ``many`` parents are not sent to all tasks."""
    parents = key_set(parent, parent_key or on).withColumn("_found", F.lit(True))
    parents = never_sent(parents) if many else parents
    return join_by(child, parents, {on: parent_key or on}, "left").withColumn(
        "has_parent", F.col("_found").isNotNull()
    ).drop("_found")
