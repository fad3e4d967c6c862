"""Exact distinct counts that can be added to and rolled up.

Every member has a dense number, and a group's members are bits in bitmaps of
fixed size, one per (group, bucket of numbers).  Bitmaps of the same group and bucket
are joined by OR, so a load is added from its own rows, the members' numbers
and the bitmaps so far, without the rows of earlier loads; and counts of wider
groups come from the same bitmaps, which plain counts could not give.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .joins import drop_matching, join_by
from .order import number_rows


@dataclass(frozen=True)
class DistinctState:
    """What is kept between loads: (member, number) and (group.., bucket, bits)."""

    members: DataFrame
    bitmaps: DataFrame


def _numbered(rows: DataFrame, member: str, known: DataFrame | None) -> DataFrame:
    """(member, number) with the members of ``rows`` that were not known at the end."""
    found = rows.select(member).dropna().distinct()
    if known is None:
        return number_rows(found, [member], "number")
    last = known.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    return known.unionByName(number_rows(drop_matching(found, known, member), [member], "number", start=last + 1))


def merge_bitmaps(bitmaps: DataFrame, groups: list[str]) -> DataFrame:
    """One bitmap per group and bucket; ``groups`` may be fewer than the bitmaps have."""
    return bitmaps.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def add_load(rows: DataFrame, groups: list[str], member: str, state: DistinctState | None = None) -> DistinctState:
    """The state with the rows of one more load; a null member counts for nothing."""
    members = settle(_numbered(rows, member, state.members if state else None), "members")
    placed = join_by(rows.select(*groups, member).dropna(subset=[member]).distinct(), members, [member])
    bits = placed.groupBy(*groups, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )
    if state:
        bits = merge_bitmaps(state.bitmaps.unionByName(bits), groups)
    return DistinctState(members, settle(bits, "bitmaps"))


def distinct_counts(state: DistinctState, groups: list[str], into: str) -> DataFrame:
    """Distinct members per group, for any of the groups of the state or none."""
    merged = merge_bitmaps(state.bitmaps, groups).select(*groups, F.bitmap_count("bits").alias("n"))
    return merged.groupBy(*groups).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias(into))
