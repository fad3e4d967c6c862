"""The catalogue of a folder, kept up to date by reading only files that are new or changed.

What is known of a folder is two small tables, published together: its files
(path, size, time, digest) and, per file and column, the kinds of cells found,
as bits.  Bits of several files are joined by OR, so the parts of a dataset, and
later files, add to a type without the earlier ones being read again.

A dataset is a file in the folder, or a subfolder whose files are its parts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import settle
from ..sources.delimited import parse_records
from ..sources.files import CHUNK, digest, list_files, stream_digests, streamable
from ..sources.records import read_records
from .catalogue import TRUE_FALSE, annotate, structure
from .loading import Load, LoadError, published_tables

#: What a cell is; a column's kinds are the bits of its cells.
WHOLE, DECIMAL, LOGICAL, TEXT, BLANK = 1, 2, 4, 8, 16

KNOWN = ["files", "columns"]
FILES = "path string, dataset string, size_bytes long, modified timestamp, sha256 string"
COLUMNS = "path string, position long, column_name string, kinds int, filled long, row_count long"

#: Files above this are told by size and time alone: Spark reads no larger file as one value.
DIGESTED = 1 << 30


def cell_kind(cell: Column) -> Column:
    """The bit of one cell."""
    # signs, points and digits lie between these two: other cells are no numbers
    number = (cell >= "+") & (cell < ":")
    return (
        F.when(cell.isNull() | (cell == ""), BLANK)
        .when(number & cell.rlike(r"^[+-]?\d+$"), WHOLE)
        .when(number & cell.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), DECIMAL)
        .when(cell.rlike(TRUE_FALSE), LOGICAL)
        .otherwise(TEXT)
    )


def type_of(kinds: Column) -> Column:
    """The narrowest type all filled cells convert to; blanks leave whole numbers and flags no type of their own."""
    filled, complete = kinds.bitwiseAND(BLANK - 1), kinds.bitwiseAND(BLANK) == 0
    return (
        F.when(filled == 0, "empty")
        .when((filled == WHOLE) & complete, "int64")
        .when(filled.bitwiseAND(LOGICAL | TEXT) == 0, "float64")
        .when((filled == LOGICAL) & complete, "bool")
        .otherwise("object")
    )


def file_columns(spark: SparkSession, paths: list[str], sep: str = "|") -> DataFrame:
    """:data:`COLUMNS` of delimited files, whatever their headers, by one aggregate over all cells.

    Columns without a name are left out; a name that repeats in a file gets
    ``.1``, ``.2``.  A file without records has its columns with no kinds.
    """
    if not paths:
        return spark.createDataFrame([], COLUMNS)
    records = read_records(spark, paths, sep)
    # separators bound the cells of a header, quoted or not
    widths = F.length("record") - F.length(F.replace("record", F.lit(sep), F.lit(""))) + 1
    widest = records.filter("_header").agg(F.max(widths)).first()[0] or 1
    slots = [f"c{at}" for at in range(widest)]
    wide = parse_records(records, slots, sep, ["_file", "_header"])
    # a record is one row up to here: only what is known of a file is turned into a row per column
    per_file = wide.filter(~F.col("_header")).groupBy("_file").agg(
        F.count("*").alias("row_count"),
        *[F.bit_or(cell_kind(F.col(c))).alias(f"_kinds_{c}") for c in slots],
        *[F.count_if(F.col(c) != "").alias(f"_filled_{c}") for c in slots],
    )
    facts = F.array(*[F.struct(F.col(f"_kinds_{c}").alias("kinds"), F.col(f"_filled_{c}").alias("filled")) for c in slots])
    counted = per_file.select("_file", "row_count", F.posexplode(facts).alias("at", "fact")).select("_file", "at", "fact.*", "row_count")
    cells = wide.filter("_header").select("_file", F.posexplode(F.array(*slots)).alias("at", "cell"))
    name = F.regexp_replace("cell", "\ufeff", "")
    named = cells.select("_file", "at", name.alias("name")).filter("name <> ''")
    # one row per column of each file
    nth = F.row_number().over(Window.partitionBy("_file", "name").orderBy("at")) - 1
    named = named.withColumn("nth", nth).withColumn(
        "name", F.when(F.col("nth") > 0, F.concat_ws(".", "name", F.col("nth").cast("string"))).otherwise(F.col("name"))
    )
    joined = named.join(counted, ["_file", "at"], "left").fillna(0, ["kinds", "filled", "row_count"])
    return joined.select(
        F.col("_file").alias("path"), (F.col("at") + 1).cast("long").alias("position"), F.col("name").alias("column_name"),
        F.col("kinds").cast("int").alias("kinds"), "filled", "row_count",
    )


def _bare(path: str) -> str:
    """A path without its scheme's spelling, which listings and callers write differently."""
    return re.sub(r"^[A-Za-z0-9+.-]+:/+", "/", path).rstrip("/")


def dataset_of(path: Column, folder: str) -> Column:
    """The first name below the folder."""
    bare = F.regexp_replace(path, r"^[A-Za-z0-9+.-]+:/+", "/")
    return F.split(F.substr(bare, F.lit(len(_bare(folder)) + 2)), "/")[0]


def known(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The two tables as published last; empty ones before the first time."""
    try:
        return published_tables(spark, root, KNOWN)
    except LoadError:
        return {"files": spark.createDataFrame([], FILES), "columns": spark.createDataFrame([], COLUMNS)}


def _paths(df: DataFrame) -> list[str]:
    """The files to read next, as a reader takes them."""
    return [row.path for row in df.select("path").collect()]


def _digests(spark: SparkSession, sizes: dict[str, int]) -> DataFrame:
    """(path, sha256) of files up to ``DIGESTED``; no task holds more than a chunk of one where it can be read in pieces."""
    large = [path for path, size in sizes.items() if CHUNK < size <= DIGESTED and streamable(path, size)]
    digests = stream_digests(spark, large)
    if whole := sorted(sizes.keys() - set(large)):
        read = list_files(spark, whole, content=True).filter(F.col("size_bytes") <= DIGESTED)
        digests = digests.unionByName(read.select("path", digest(F.col("content"))["sha256"].alias("sha256")))
    return digests


def update(spark: SparkSession, folder: str, root: str, sep: str = "|", pattern: str = "*.csv") -> tuple[Load, list[str]]:
    """Bring what is known under ``root`` up to date; returns the load and the files whose records were read.

    Files of the same path, size and time as before are not opened.  Others are
    digested, and their records read only if the digest is new too.  Files that
    are gone are forgotten.  Nothing is published before both tables are whole.
    """
    before = known(spark, root)
    listed = settle(
        list_files(spark, folder, pattern).select("path", dataset_of(F.col("path"), folder).alias("dataset"), "size_bytes", "modified"), "listed"
    )
    facts = ["path", "size_bytes", "modified"]
    same = listed.join(before["files"].select(*facts, "sha256"), facts).select(*listed.columns, "sha256")
    touched = {row.path: row.size_bytes for row in listed.join(before["files"], facts, "left_anti").collect()}
    files, unread = same, same.select("path")
    read: list[str] = []
    if touched:
        opened = settle(listed.join(before["files"], facts, "left_anti").join(_digests(spark, touched), "path", "left"), "opened")
        moved = opened.join(before["files"].filter("sha256 is not null"), ["path", "sha256"], "left_semi")
        read = sorted(_paths(opened.join(moved, "path", "left_anti")))
        files, unread = same.unionByName(opened), unread.unionByName(moved.select("path"))
    kept = before["columns"].join(unread, "path", "left_semi")
    load = Load(spark, root)
    load.add_all({"files": files, "columns": kept.unionByName(file_columns(spark, read, sep))})
    load.publish()
    return load, read


def dataset_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """(file, position, column_name, dtype, filled, row_count, column_count) of every dataset.

    Columns of parts meet by name, whatever their places; where a part lacks a
    column, its cells are blank.
    """
    placed = tables["columns"].join(tables["files"].select("path", F.col("dataset").alias("file")), "path")
    rows = placed.groupBy("file", "path").agg(F.max("row_count").alias("n")).groupBy("file").agg(F.sum("n").alias("rows"))
    merged = placed.groupBy("file", "column_name").agg(
        F.min("position").alias("position"), F.bit_or("kinds").alias("kinds"), F.sum("filled").alias("filled"),
        F.sum("row_count").alias("present"),
    )
    sizes = merged.groupBy("file").agg(F.count("*").alias("column_count")).join(rows, "file")
    blank = F.when(F.col("present") < F.col("rows"), BLANK).otherwise(0)
    return merged.join(sizes, "file").select(
        "file", "position", "column_name", type_of(F.col("kinds").bitwiseOR(blank)).alias("dtype"), "filled",
        F.col("rows").alias("row_count"), "column_count",
    )


def describe(tables: dict[str, DataFrame], crosswalk: DataFrame) -> DataFrame:
    """One row per dataset: title, file, sizes, times, structure with meanings.

    ``issued`` is the time of its oldest file, ``modified`` that of its newest.
    """
    described = structure(annotate(dataset_columns(tables), crosswalk), ["file"])
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    facts = tables["files"].groupBy(F.col("dataset").alias("file")).agg(
        F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("file_count"),
        F.date_format(F.min("modified"), iso).alias("issued"), F.date_format(F.max("modified"), iso).alias("modified"),
    )
    title = F.regexp_replace("file", r"\.[^.]*$", "").alias("title")
    return described.join(facts, "file").select(title, "*")
