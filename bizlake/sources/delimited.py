"""Delimited text: every column arrives as a string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import null_when_token
from ..operators.order import land, number_in_file_order
from ..session import settle
from .records import number_records, read_records
from .workbooks import read_sheet


class ColumnCountError(ValueError):
    """A file has another number of columns than its fixed schema."""


class MissingColumnsError(ValueError):
    """A table lacks columns a step needs."""


class HeaderError(ValueError):
    """Files read as one table have different headers."""


def _reader(spark: SparkSession, sep: str, multi_line: bool):
    return (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("encoding", "UTF-8")
    )


def header_columns(spark: SparkSession, path: str, sep: str, multi_line: bool = True) -> list[str]:
    """Column names of a delimited file, without byte-order mark."""
    names = _reader(spark, sep, multi_line).csv(path).columns
    return [name.replace("\ufeff", "") for name in names]


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str,
    blanks: str = "null",
    row_number: str | None = None,
    multi_line: bool = True,
    columns: list[str] | None = None,
) -> DataFrame:
    """Scan a delimited file or folder into string columns.

    ``blanks`` is ``"null"`` to turn blank cells and missing-value words into
    null, or ``"keep"`` to keep all text and read blank cells as ``''``.
    ``row_number`` adds the 1-based position in file order under that name.
    ``multi_line`` allows line breaks inside quotes; files are read by as many
    tasks as they have splits either way.  All files of a folder must have the
    same header.
    """
    names = columns or header_columns(spark, path, sep, multi_line)
    if multi_line:
        records = read_records(spark, path, sep)
        _same_headers(records)
        rows = number_records(records, row_number) if row_number else records.filter(~F.col("_header"))
        return _with_blanks(parse_records(rows, names, sep, [row_number] if row_number else []), names, blanks)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    scan = _reader(spark, sep, multi_line).schema(schema).csv(path)
    if row_number:
        scan = number_in_file_order(land(scan), row_number)
    return _with_blanks(scan, names, blanks)


def parse_records(records: DataFrame, names: list[str], sep: str, keep: list[str]) -> DataFrame:
    """The cells of each record under ``names``, then the columns to keep."""
    ddl = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    options = {"sep": sep, "quote": '"', "escape": '"', "columnNameOfCorruptRecord": "_broken"}
    cells = records.select(F.from_csv("record", ddl, options).alias("_cells"), *keep)
    return cells.select("_cells.*", *keep)


def _same_headers(records: DataFrame) -> None:
    """Stop where two files have different headers."""
    clean = F.regexp_replace("record", "\ufeff", "")
    headers = records.filter("_header").groupBy(clean.alias("record")).agg(F.min("_file").alias("file")).limit(2).collect()
    if len(headers) > 1:
        raise HeaderError(f"different headers in {headers[0].file} and {headers[1].file}")


def read_skipping_long_lines(
    spark: SparkSession,
    path: str,
    sep: str = ";",
    row_number: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """As :func:`read_delimited`, leaving out records with too many fields.

    Records with too few fields stay, padded with null.
    """
    names = header_columns(spark, path, sep, multi_line)
    if multi_line:
        records = read_records(spark, path, sep)
        _same_headers(records)
        rows = number_records(records, row_number) if row_number else records.filter(~F.col("_header"))
        landed = parse_records(rows, [*names, "_broken"], sep, [row_number] if row_number else [])
    else:
        schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, "_broken"]])
        scan = (
            _reader(spark, sep, multi_line)
            .schema(schema)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_broken")
            .csv(path)
        )
        landed = number_in_file_order(land(scan), row_number) if row_number else settle(scan, "landed")
    kept = landed.filter(
        F.col("_broken").isNull() | (count_delimiters(F.col("_broken"), sep) < len(names))
    ).drop("_broken")
    return _with_blanks(kept, names, "null")


def count_delimiters(record, sep: str):
    """Delimiters of a raw record outside quotes."""
    bare = F.regexp_replace(record, r'"[^"]*"', "")
    return F.length(F.regexp_replace(bare, f"[^{sep}]", ""))


def _with_blanks(df: DataFrame, names: list[str], blanks: str) -> DataFrame:
    quoted = {name: F.col(f"`{name}`") for name in names}
    if blanks == "keep":
        return df.withColumns({n: F.coalesce(c, F.lit("")) for n, c in quoted.items()})
    return df.withColumns({n: null_when_token(c) for n, c in quoted.items()})


def load_table(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Read a workbook or a delimited file, by the ending of its name."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "xlsx":
        return read_sheet(spark, path)
    if ending == "csv":
        return read_delimited(spark, path, sep)
    raise ValueError(f"unsupported file format: .{ending}")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` itself, or an error naming the columns it lacks."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing columns: {missing}")
    return df


def require_column_count(df: DataFrame, n: int) -> DataFrame:
    """``df`` itself, or an error when it has not ``n`` columns."""
    if len(df.columns) != n:
        raise ColumnCountError(f"expected {n} columns, found {len(df.columns)}")
    return df
