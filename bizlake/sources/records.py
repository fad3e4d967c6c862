"""Records of quoted text files, read by many tasks each.

A line break inside quotes does not end a record, and whether a split of a file
begins inside quotes depends on everything before it.  What one line does is
small, though: given whether it begins inside quotes, it ends inside or outside.
The lines of a split together are such a pair again, one small row per split,
and running through these rows in file order tells how every split begins.  Each
split then puts its lines together by itself; the records that cross a border,
at most one per border, are joined from their parts.

Fields follow the usual rules: a quote opens a cell only at its beginning, two quotes
inside are one, and text after the closing quote belongs to the cell.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import settle

WHOLE, HEAD, TAIL, MIDDLE = range(4)

_PARTS = pa.schema([
    ("_file", pa.string()), ("_block", pa.int64()), ("_at", pa.int64()), ("_kind", pa.int32()),
    ("_header", pa.bool_()), ("_record", pa.binary()),
])
_PARTS_DDL = "_file string, _block long, _at long, _kind int, _header boolean, _record binary"


def quote_steps(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends inside quotes if it begins outside, and if it begins inside."""
    other = f"[^{re.escape(sep)}]"
    inside = r'[^"]*+(?:""[^"]*+)*+'
    field = rf'(?:"{inside}"{other}*+|[^"{re.escape(sep)}]{other}*+|)'
    opened = rf'(?:{field}{re.escape(sep)})*+"{inside}'
    quoted = line.contains('"')
    outside = F.when(quoted, line.rlike(rf"\A{opened}\z")).otherwise(False)
    within = F.when(quoted, line.rlike(rf'\A{inside}(?:|"{other}*+{re.escape(sep)}{opened})\z')).otherwise(True)
    return outside, within


def _lines(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """(_file, _block, _line, _out, _in): lines in file order within each split."""
    scan = spark.read.option("lineSep", "\n").text(path)
    outside, within = quote_steps(F.col("_line"), sep)
    placed = scan.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.col("value").alias("_line"),
    )
    return placed.select("_file", "_block", "_line", outside.alias("_out"), within.alias("_in"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The stretches of a batch that come from one split."""
    files, blocks = batch.column("_file").dictionary_encode(), batch.column("_block").to_numpy()
    codes = files.indices.to_numpy()
    changes = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
    for a, b in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows]):
        if b > a:
            yield files.dictionary[int(codes[a])].as_py(), int(blocks[a]), batch.slice(a, b - a)


def _bits(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int8)


def states(outside: np.ndarray, within: np.ndarray, start: int) -> np.ndarray:
    """1 after each line that ends inside quotes, the first line beginning in ``start``."""
    at = np.arange(len(outside))
    fixed = np.maximum.accumulate(np.where(outside == within, at, -1))  # the last line whose end its begin does not change
    flips = np.cumsum((outside == 1) & (within == 0))
    base = np.where(fixed >= 0, outside[fixed], start)
    return base ^ ((flips - np.where(fixed >= 0, flips[fixed], 0)) & 1)


def _summaries(batches) -> Iterator[pa.RecordBatch]:
    """(_file, _block, _out, _in, _crlf) per split."""
    now, ends = None, [0, 1]

    def row(crlf):
        return pa.RecordBatch.from_pydict(
            {"_file": [now[0]], "_block": [now[1]], "_out": [bool(ends[0])], "_in": [bool(ends[1])], "_crlf": [crlf]}
        )

    crlf = False
    for batch in batches:
        for file, block, run in _runs(batch):
            if now != (file, block):
                if now:
                    yield row(crlf)
                now, ends, crlf = (file, block), [0, 1], bool(run.column("_cr")[0].as_py())
            ends = [int(states(_bits(run, "_out"), _bits(run, "_in"), s)[-1]) for s in ends]
    if now:
        yield row(crlf)


def _starts(lines: DataFrame) -> DataFrame:
    """(_file, _block, _open, _crlf) of the splits that begin inside quotes or whose file ends lines with CR LF."""
    seen = lines.select("_file", "_block", "_out", "_in", F.col("_line").endswith("\r").alias("_cr"))
    per_split = settle(seen.mapInArrow(_summaries, "_file string, _block long, _out boolean, _in boolean, _crlf boolean"), "splits")
    # the same step as over lines: the last fixed split before this one, and the flips since
    before = Window.partitionBy("_file").orderBy("_block")
    fixed = F.when(F.col("_out") == F.col("_in"), F.struct("_block", "_out"))
    flip = (F.col("_out") & ~F.col("_in")).cast("int")
    run = per_split.withColumn("_flips", F.sum(flip).over(before)).withColumn(
        "_fixed", F.last(F.when(fixed.isNotNull(), F.struct("_out", "_flips")), ignorenulls=True).over(before)
    )
    base = F.coalesce(F.col("_fixed._out").cast("int"), F.lit(0))
    after = (base + F.col("_flips") - F.coalesce(F.col("_fixed._flips"), F.lit(0))) % 2 == 1
    placed = run.select(
        "_file", "_block", F.coalesce(F.lag(after).over(before), F.lit(False)).alias("_open"),
        F.first("_crlf").over(before).alias("_crlf"),
    )
    return placed.filter("_open or _crlf")


class _Split:
    """The records of one split, line by line."""

    def __init__(self, file: str, block: int, opened: bool, crlf: bool):
        self.key, self.state, self.crlf = (file, block), int(opened), crlf
        self.pending: list[bytes] = []
        self.started = not opened  # whether what is pending began in this split
        self.header = block == 0  # whether the header is still to come
        self.at = 0
        self.out: list[tuple[int, int, bool, bytes]] = []

    def add(self, run: pa.RecordBatch) -> None:
        lines = run.column("_line").to_pylist()
        if self.crlf:
            lines = [line.removesuffix(b"\r") for line in lines]
        after = states(_bits(run, "_out"), _bits(run, "_in"), self.state)
        at = 0
        for end in (np.flatnonzero(after == 0) + 1).tolist():
            self.pending += lines[at:end]
            self.close(WHOLE if self.started else HEAD)
            at = end
        self.pending += lines[at:]
        self.state = int(after[-1])

    def close(self, kind: int) -> None:
        record = self.pending[0] if len(self.pending) == 1 else b"\n".join(self.pending)
        begins = kind in (WHOLE, TAIL)
        if record or not begins:  # blank lines between records are none
            self.out.append((self.at if begins else -1, kind, begins and self.header, record))
            self.at += begins and not self.header
            self.header = self.header and not begins
        self.pending, self.started = [], True

    def end(self) -> None:
        if self.pending:
            self.close(TAIL if self.started else MIDDLE)

    def taken(self) -> pa.RecordBatch:
        at, kind, header, record = zip(*self.out)
        n, self.out = len(self.out), []
        columns = [[self.key[0]] * n, [self.key[1]] * n, at, kind, header, record]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTS)], schema=_PARTS)


def _parts(batches) -> Iterator[pa.RecordBatch]:
    split = None
    for batch in batches:
        for file, block, run in _runs(batch):
            if split is None or split.key != (file, block):
                if split:
                    split.end()
                    if split.out:
                        yield split.taken()
                split = _Split(file, block, run.column("_open")[0].as_py(), run.column("_crlf")[0].as_py())
            split.add(run)
            if split.out:
                yield split.taken()
    if split:
        split.end()
        if split.out:
            yield split.taken()


def read_records(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """(_file, _block, _at, _header, record) of delimited files or folders, by any number of tasks.

    ``_at`` counts the records that begin in the split, from 0, without the
    header.  Row order within the result means nothing.
    """
    lines = _lines(spark, path, sep)
    # one row per split at most, and only of those whose begin is not the usual one
    known = F.broadcast(_starts(lines))
    placed = lines.withColumn("_line", F.col("_line").cast("binary")).join(known, ["_file", "_block"], "left").fillna(False, ["_open", "_crlf"])
    parts = settle(placed.mapInArrow(_parts, _PARTS_DDL), "records")
    whole = parts.filter(F.col("_kind") == WHOLE)
    # at most two parts per split; one that begins a record is followed by those that go on
    order = Window.partitionBy("_file").orderBy("_block", "_kind")
    begins = F.last(F.when(F.col("_kind") == TAIL, F.struct("_block", "_at", "_header")), ignorenulls=True).over(order)
    crossing = parts.filter(F.col("_kind") != WHOLE).withColumn("_begin", begins)
    texts = F.array_sort(F.collect_list(F.struct("_block", F.col("_record").cast("string").alias("text"))))
    joined = crossing.groupBy("_file", "_begin").agg(F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("record"))
    return whole.select("_file", "_block", "_at", "_header", F.col("_record").cast("string").alias("record")).unionByName(
        joined.select("_file", "_begin._block", "_begin._at", "_begin._header", "record")
    )


def number_records(records: DataFrame, into: str) -> DataFrame:
    """The number of each record in file order, from 1, headers left out."""
    rows = records.filter(~F.col("_header"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    # one row per split
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(starts), ["_file", "_block"]).withColumn(into, F.col("_before") + F.col("_at") + 1).drop("_before")
