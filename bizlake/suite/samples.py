"""Files made from the test tables: workbooks, archives and lines with faults."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..sources.files import _open

#: Files that a folder of many small ones holds.
FILES_IN_FOLDER = 10_000

#: Rows of an archive that are turned into text together.
ROWS_AT_A_TIME = 200

_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook_bytes(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook with text cells only."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        names = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)
        )
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{_NS}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>',
        )
        links = "".join(
            f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>'
            for i in range(1, len(sheets) + 1)
        )
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(
                "<row>" + "".join(
                    f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>'
                    for c in row
                ) + "</row>"
                for row in rows
            )
            book.writestr(
                f"xl/worksheets/sheet{i}.xml",
                f'<worksheet xmlns="{_NS}"><sheetData>{body}</sheetData></worksheet>',
            )
    return out.getvalue()


def as_workbooks(df: DataFrame, sheet: str, second: str | None = None) -> DataFrame:
    """Workbooks (path, content) holding the rows of a string table, one per Arrow batch.

    A ``second`` sheet repeats the first two columns.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [list(batch.columns), *batch.fillna("").values.tolist()]
            sheets = {sheet: rows}
            if second:
                sheets[second] = [row[:2] for row in rows]
            content = workbook_bytes(sheets)
            name = hashlib.md5(content).hexdigest()
            yield pd.DataFrame({"path": [f"{name}.xlsx"], "content": [content]})

    return df.mapInPandas(pack, "path string, content binary")


def write_archives(df: DataFrame, folder: str) -> None:
    """Zip archives under ``folder`` with the rows of a table; one broken file beside them.

    An archive is named by its task and written a few rows at a time, so that a
    repeated task replaces it and no archive is held in memory.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, (fs, inner) = TaskContext.get().partitionId(), _open(folder)
        fs.create_dir(inner, recursive=True)
        for number, batch in enumerate(b for b in batches if b.num_rows):
            # pandas would turn the numbers of some slices only into decimals: those with a missing one
            whole = [c.cast(pa.float64(), safe=False) if pa.types.is_integer(c.type) and c.null_count else c for c in batch.columns]
            batch = pa.RecordBatch.from_arrays(whole, names=batch.schema.names)
            path = f"{inner}/{task:06d}-{number:06d}.zip"
            with fs.open_output_stream(path) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as archive:
                with archive.open("csv/Project.csv", "w", force_zip64=True) as member:
                    for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
                        rows = batch.slice(at, ROWS_AT_A_TIME).to_pandas()
                        member.write(rows.to_csv(sep=";", index=False, header=at == 0).encode())
                archive.writestr("csv/webLink.csv", "a;b\n")
            yield pa.RecordBatch.from_pydict({"path": [path]})

    df.mapInArrow(pack, "path string").write.format("noop").mode("overwrite").save()
    fs, inner = _open(folder)
    with fs.open_output_stream(f"{inner}/broken.zip") as sink:
        sink.write(b"this is not an archive")


def write_files(df: DataFrame, key: str, folder: str) -> None:
    """Write each text of the column ``value`` as a line to a file named by its key.

    A task writes to a folder of its own, at most ``FILES_IN_FOLDER`` files to each
    of its parts; its rows of the same key share a file.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, fs, sink, last, n = TaskContext.get().partitionId(), None, None, None, 0
        for batch in batches:
            for name, value in zip(batch["key"], batch["value"]):
                if sink is None or name != last:
                    if sink:
                        sink.close()
                    part = f"{folder}/part-{task}/{n // FILES_IN_FOLDER}"
                    if n % FILES_IN_FOLDER == 0:
                        fs, inner = _open(part)
                        fs.create_dir(inner, recursive=True)
                    sink = fs.open_output_stream(f"{inner}/{key}={name}.txt")
                    last, n = name, n + 1
                sink.write((value or "").encode() + b"\n")
        if sink:
            sink.close()
        yield pd.DataFrame({"n": [n]})

    named = df.select(F.coalesce(F.col(key).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("key"), "value")
    named.sortWithinPartitions("key").mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()


def write_lines(df: DataFrame, header: str, path: str) -> None:
    """Write the text column ``value`` as lines, each file starting with the header."""

    def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [header]})
        yield from batches

    df.select(F.col("value").cast("string")).mapInPandas(lead, "value string").write.text(path)
