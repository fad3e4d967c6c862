"""Serving tables: trimmed text, first row per key, no fact without its parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config
from ..functions import trim_or_empty
from ..operators.dedup import keep_first
from ..operators.joins import ROWS_SENT, split_by_parent
from .loading import Load

TABLES = ["headquarters", "registry", "project", "financial", "organization", "topics"]


def serving_columns(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """The chosen columns as stripped text without nulls; absent columns are blank."""
    present = set(df.columns)
    return df.select(
        *[
            (trim_or_empty(F.col(f"`{c}`").cast("string")) if c in present else F.lit("")).alias(c)
            for c in columns
        ],
        *keep,
    )


def with_key(df: DataFrame, key: str) -> DataFrame:
    """Rows with a key that is not blank."""
    return df.filter(F.col(key) != "")


def load_headquarters(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per company, the first in file order."""
    rows = with_key(serving_columns(df, config.COMPANY_COLUMNS, order), "cf")
    return keep_first(rows, ["cf"], order).drop(*order)


def load_registry(df: DataFrame, row_id: str) -> DataFrame:
    return with_key(serving_columns(df, config.COMPANY_COLUMNS, [row_id]), "cf")


def load_projects(df: DataFrame, order: list[str]) -> DataFrame:
    rows = with_key(serving_columns(df, config.PROJECT_COLUMNS, order), "projectID")
    return keep_first(rows, ["projectID"], order).drop(*order)


def load_children(
    df: DataFrame, columns: list[str], parent: DataFrame, on: str, keep: list[str] = (), many: bool = False
) -> DataFrame:
    """Child rows with ``has_parent``; blank keys have none.

    Rows are joined as they come, with their key stripped, and get their blank columns
    afterwards; ``many`` parents are not sent to all tasks.
    """
    others = [F.col(f"`{c}`") for c in columns if c in df.columns and c != on]
    linked = split_by_parent(serving_columns(df, [on], [*others, *keep]), parent, on, many=many)
    return serving_columns(linked, columns, [*keep, "has_parent"])


def accepted(children: DataFrame) -> DataFrame:
    return children.filter("has_parent").drop("has_parent")


def organization_children(df: DataFrame, project: DataFrame, keep: list[str] = (), many: bool = False) -> DataFrame:
    """Organisations with ``has_parent``; a blank tax code is null."""
    rows = load_children(df, config.ORGANIZATION_COLUMNS, project, "projectID", keep, many)
    return rows.withColumn("cf", F.nullif("cf", F.lit("")))


def children_of(
    sources: dict[str, DataFrame], headquarters: DataFrame, project: DataFrame, many: set[str] = frozenset()
) -> dict[str, DataFrame]:
    """The three child tables, each row with ``has_parent``; parents in ``many`` are not sent to all tasks."""
    of_project = "project" in many
    return {
        "financial": load_children(sources["financial"], config.FINANCIAL_COLUMNS, headquarters, "cf", many="headquarters" in many),
        "organization": organization_children(sources["organization"], project, many=of_project),
        "topics": load_children(sources["topics"], config.TOPIC_COLUMNS, project, "projectID", many=of_project),
    }


def build_serving(sources: dict[str, DataFrame], row_id: str = "row_id") -> dict[str, DataFrame]:
    """Six serving tables from the six exports, as plans.

    Expects headquarters, registry, financial, project, organization and
    topics, each with ``row_id``.
    """
    headquarters = load_headquarters(sources["headquarters"], [row_id])
    project = load_projects(sources["project"], [row_id])
    children = children_of(sources, headquarters, project)
    return {
        "headquarters": headquarters,
        "registry": load_registry(sources["registry"], row_id),
        "project": project,
        **{name: accepted(rows) for name, rows in children.items()},
    }


def load_serving(
    sources: dict[str, DataFrame], root: str, row_id: str = "row_id", tables: list[str] = TABLES
) -> Load:
    """Write the serving tables as one load, not yet published.

    Parents are written first; their children are matched with them as they
    were written, so no parent is computed twice, and by shuffling where more
    than ``ROWS_SENT`` were counted.
    """
    load = Load(sources["headquarters"].sparkSession, root)
    first = {
        "headquarters": load_headquarters(sources["headquarters"], [row_id]),
        "project": load_projects(sources["project"], [row_id]),
    }
    if "registry" in tables:
        first["registry"] = load_registry(sources["registry"], row_id).drop(row_id)
    written = load.add_all(first)
    many = {table for table in first if load.counts[table]["loaded"] > ROWS_SENT}
    children = children_of(sources, written["headquarters"], written["project"], many)
    load.add_all({name: rows for name, rows in children.items() if name in tables})
    return load
