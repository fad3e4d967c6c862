"""Financial statements: check every cell, set bad rows aside, keep vanished companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config
from ..functions import (
    checked_float, checked_int, normalise_identifier, null_when_token, strip,
)
from ..operators.joins import drop_matching
from ..session import settle
from ..sources.delimited import require_column_count

def with_safe_names(raw: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Give the 21 columns their table names, by position; other counts are an error."""
    cells = require_column_count(raw.drop(row_id), len(config.FINANCIAL_SCHEMA))
    kept = [row_id] if row_id in raw.columns else []
    return raw.select(*[f"`{c}`" for c in cells.columns], *kept).toDF(
        *config.FINANCIAL_COLUMNS, *kept
    )


def check_cells(named: DataFrame) -> DataFrame:
    """Typed columns, and ``bad_columns``: the names of cells that do not convert.

    A missing whole number is bad; missing text and decimals are null values.
    Each step is a projection of its own, so a cell is stripped and matched once.
    """
    kinds = {column: kind for _, kind, column in config.FINANCIAL_SCHEMA}
    numeric = [c for c, kind in kinds.items() if kind != "string"]
    stripped = named.withColumns({c: strip(F.col(c)) for c in numeric})
    present = stripped.withColumns({c: null_when_token(F.col(c)) for c in kinds})
    converted = present.withColumns({
        f"_{c}": (checked_int if kinds[c] == "int" else checked_float)(F.col(c)) for c in numeric
    })
    failed = []
    for name, kind, column in config.FINANCIAL_SCHEMA:
        if kind == "int":
            failed.append(F.when(F.col(f"_{column}").isNull(), F.lit(name)))
        elif kind == "float":
            unread = F.col(column).isNotNull() & F.col(f"_{column}").isNull()
            failed.append(F.when(unread, F.lit(name)))
    others = [c for c in named.columns if c not in kinds]
    return converted.select(
        *others,
        *[F.col(f"_{c}").alias(c) if c in numeric else F.col(c) for c in kinds],
        F.array_compact(F.array(*failed)).alias("bad_columns"),
    )


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("bad_columns") == 0).select(*config.FINANCIAL_COLUMNS)


def error_rows(checked: DataFrame, row_id: str = "row_id") -> DataFrame:
    """riga (line of the file, the header being line 1), errore, bad_columns.

    ``row_id`` counts from 1, so the line is one more.
    """
    return checked.filter(F.size("bad_columns") > 0).select(
        (F.col(row_id) + 1).cast("bigint").alias("riga"),
        F.concat(F.lit("cannot convert: "), F.element_at("bad_columns", 1)).alias("errore"),
        F.concat_ws(";", "bad_columns").alias("bad_columns"),
    )


def typed_like(previous: DataFrame, current: DataFrame) -> DataFrame:
    """The current columns of an earlier output: blanks null, decimal commas read."""
    cells = []
    for field in current.schema:
        cell = F.col(field.name)
        if previous.schema[field.name].dataType.simpleString() == "string":
            cell = F.nullif(cell, F.lit(""))
        if previous.schema[field.name].dataType != field.dataType:
            cell = F.replace(cell, F.lit(","), F.lit(".")).try_cast(field.dataType)
        cells.append(cell.alias(field.name))
    return previous.select(*cells)


def vanished_rows(current: DataFrame, previous: DataFrame, key: str = "cf") -> DataFrame:
    """Distinct rows of the previous output whose company is not in the current one."""
    now = current.select(normalise_identifier(F.col(key)).alias("_id")).filter("_id != ''")
    before = previous.withColumn("_id", normalise_identifier(F.col(key))).filter("_id != ''")
    return typed_like(drop_matching(before, now, "_id"), current).distinct()


def carry_forward(current: DataFrame, previous: DataFrame | None, key: str = "cf") -> DataFrame:
    """Current rows plus the vanished rows of the previous output.

    Nothing is carried when there is no previous output or when it lacks a
    current column.  An empty current table keeps every previous row.
    """
    if previous is None or any(c not in previous.columns for c in current.columns):
        return current
    return current.unionByName(vanished_rows(current, previous, key))


def run_financial(
    raw: DataFrame, previous: DataFrame | None = None, row_id: str = "row_id"
) -> dict[str, DataFrame]:
    """A 21-column table of strings in; ``valid`` and ``errors`` out.

    Cells are converted once and written; both results read that table.
    """
    checked = settle(check_cells(with_safe_names(raw, row_id)), "checked")
    return {
        "valid": carry_forward(valid_rows(checked), previous),
        "errors": error_rows(checked, row_id),
    }
