"""Workbook sheets as rows of text cells."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import settle

# fixed values: names used inside the workbook format
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), 45, 46, 47}
ROWS_PER_BATCH = 5_000
CELL_SCHEMA = "path string, sheet string, row long, cells array<string>"


def _column_index(reference: str) -> int:
    index = 0
    for letter in reference:
        if not letter.isalpha():
            break
        index = index * 26 + ord(letter) - 64
    return index - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    codes = {
        int(n.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", n.get("formatCode", ""))
        for n in root.iter(f"{MAIN}numFmt")
    }
    dates = DATE_FORMATS | {i for i, code in codes.items() if re.search("[ymdh]", code.lower())}
    cells = root.find(f"{MAIN}cellXfs")
    formats = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
    return {style for style, number in enumerate(formats) if number in dates}


def _cell_text(cell, shared: list[str], dates: set[int]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    raw = cell.findtext(f"{MAIN}v")
    if raw is None:
        return ""
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        return str(dt.datetime(1899, 12, 30) + dt.timedelta(days=float(raw)))
    if kind == "n" and "." not in raw and "e" in raw.lower():
        return str(float(raw))
    return raw


def _sheet_rows(book: zipfile.ZipFile) -> Iterator[tuple[str, int, list[str]]]:
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
    targets = {
        r.get("Id"): r.get("Target").removeprefix("/xl/")
        for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    dates = _date_styles(book)
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        with book.open("xl/" + targets[sheet.get(LINK)]) as stream:
            number = 0
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{MAIN}row":
                    continue
                number = int(row.get("r", number + 1))
                cells: list[str] = []
                for cell in row:
                    at = _column_index(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells += [""] * (at - len(cells)) + [_cell_text(cell, shared, dates)]
                yield sheet.get("name"), number, cells
                row.clear()


def _workbook_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows: list[tuple] = []
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                for sheet, number, cells in _sheet_rows(book):
                    rows.append((path, sheet, number, cells))
                    if len(rows) == ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])
                        rows = []
            yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])


def workbook_cells(files: DataFrame) -> DataFrame:
    """Rows of all sheets of many workbooks: path, sheet, row (1 is the header), cells.

    ``files`` has ``path`` and ``content``.  A workbook is read by one task;
    the format itself ends a sheet at 1,048,576 rows.
    """
    return files.select("path", "content").mapInPandas(_workbook_cells, CELL_SCHEMA)


def open_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Workbook files with their content, one workbook per task."""
    return spark.read.format("binaryFile").load(path).select("path", "content").repartition("path")


def sheet_names(cells: DataFrame) -> list[str]:
    """Names of the sheets present (metadata only)."""
    return [r.sheet for r in cells.select("sheet").distinct().collect()]


def require_sheets(cells: DataFrame, expected: list[str]) -> DataFrame:
    """``cells`` itself, or an error when the sheets are not exactly the expected ones."""
    found = sheet_names(cells)
    if sorted(found) != sorted(expected):
        raise ValueError(f"expected sheets {expected}, found {sorted(found)}")
    return cells


def sheet_table(cells: DataFrame, sheet: str, columns: list[str], row: str | None = None) -> DataFrame:
    """One sheet as a string table: cells by position, blanks and missing cells as ``''``."""
    body = cells.filter((F.col("sheet") == sheet) & (F.col("row") > 1))
    table = body.select(
        *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)],
        *([(F.col("row") - 1).alias(row)] if row else []),
    )
    return table


def sheet_header(cells: DataFrame, sheet: str) -> list[str]:
    """Column names of a sheet, from its first row (metadata only)."""
    first = cells.filter((F.col("sheet") == sheet) & (F.col("row") == 1)).select("cells").first()
    if first is None:
        raise ValueError(f"sheet {sheet!r} not found")
    return list(first.cells)


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet (the first found when not named) of a workbook as a string table."""
    cells = workbook_cells(open_workbooks(spark, path))
    name = sheet or cells.select("sheet").first().sheet
    return sheet_table(cells, name, sheet_header(cells, name))


def read_workbook(
    spark: SparkSession, path: str, sheets: list[str], row: str | None = None
) -> dict[str, DataFrame]:
    """The expected sheets of a workbook as string tables, with row numbers if named.

    The workbook is parsed once; sheets, headers and rows come from that table.
    """
    cells = settle(workbook_cells(open_workbooks(spark, path)), "cells")
    require_sheets(cells, sheets)
    return {s: sheet_table(cells, s, sheet_header(cells, s), row) for s in sheets}
