"""What the text operators share: the documents table, row keys, blobs by bucket."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in every contract: blank and the controls 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"

#: Bytes of text that one task or one block should hold.
BLOCK_BYTES = 16 << 20

#: Stands for a null id inside tasks, where ids travel as plain integers.
NO_ID = -(1 << 63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id, text (null as empty) and a hash of the text.

    Id and hash tell rows apart whose ids repeat; rows that repeat in both are
    the same row for every purpose here.  Other columns, whatever their names,
    are left behind.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "text_hash", F.xxhash64("text")
    )


def held_out(id_col: str, modulus: int, remainder: int = 2) -> Column:
    """True for the rows whose crc32 of the id as text has this remainder."""
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return (crc % modulus) == remainder


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; one number, used to size blocks."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def parts_for(spark: SparkSession, n_bytes: float) -> int:
    """Shuffle partitions for so many bytes: the session's number, or more if blocks need it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / BLOCK_BYTES), 1)


def chunks(batches: Iterable[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds about ``limit`` bytes of its text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def by_key(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows of a partition sorted by ``key``, one key at a time."""
    current, rows = None, []
    for batch in batches:
        for row in (r for at in range(0, batch.num_rows, 16) for r in batch.slice(at, 16).to_pylist()):
            if rows and row[key] != current:
                yield current, rows
                rows = []
            current = row[key]
            rows.append(row)
    if rows:
        yield current, rows


def as_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class WordBuffer:
    """Words of several texts in one byte buffer, with hashes of any run of words.

    ``texts`` hold words joined by one blank and no line break.  Hashes come
    from running sums of bytes times powers of an odd number, so equal runs have
    equal hashes wherever they stand.
    """

    STEP = np.uint64(0x9E3779B97F4A7C55)
    _powers = _inverse = np.ones(1, dtype=np.uint64)

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts)
        data = np.frombuffer(self.raw, dtype=np.uint8)
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[: len(data)], out=sums[1:])
        gaps = np.flatnonzero((data == 32) | (data == 10))
        self.start = np.concatenate([[0], gaps + 1]).astype(np.int64)
        self.end = np.concatenate([gaps, [len(data)]]).astype(np.int64)
        self._sums = sums
        breaks = data[gaps] == 10
        self.piece = np.concatenate([[0], np.cumsum(breaks)]).astype(np.int64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) < n:
            inverse = np.uint64(pow(int(cls.STEP), -1, 1 << 64))
            for name, base in (("_powers", cls.STEP), ("_inverse", inverse)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from each start to each end."""
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    if have < width:
        rest = width - have
        values = np.minimum(values[:-rest], values[rest:])
    return values


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers from each start on, ``lengths`` of them, in a row."""
    if not len(starts):
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)
