"""Substring search by an index of trigrams.

Every three characters in a row of a field, in lower case, make a posting.  A
posting (gram, field, rows) lists the rows of one batch of a task, which sorts
its grams as numbers, so lists, not single rows, are shuffled.  Postings lie
sorted by gram, so a search reads the few files and row groups of its own grams;
rows that have all of them in one field are looked
up in the buckets that hold them and tested with ``contains``.  Words of fewer
than three characters have no grams and scan the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import contains_ignoring_case
from ..session import fresh_path, settle

GRAM = 3
#: Folders that the indexed rows are dealt to.
BUCKETS = 64


def grams(text: Column) -> Column:
    """Distinct runs of three characters of the text in lower case."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    found = F.array_distinct(F.transform(starts, lambda at: F.substring(low, at, F.lit(GRAM))))
    return F.when(F.length(low) >= GRAM, found).otherwise(F.array().cast("array<string>"))


_POSTINGS = pa.schema([("gram", pa.string()), ("field", pa.int32()), ("rows", pa.list_(pa.int64()))])
#: Characters whose grams a task sorts at once.
_CHARACTERS = 1 << 20


def _gram_lists(texts: list[str | None], rows: np.ndarray, field: int) -> pa.RecordBatch:
    """Postings of some texts of one field."""
    kept = [k for k, text in enumerate(texts) if text and len(text) >= GRAM]
    points = np.frombuffer("".join([texts[k] for k in kept]).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    sizes = np.array([len(texts[k]) for k in kept], dtype=np.int64)
    owner = np.repeat(rows[kept], sizes)
    # 21 bits a character; a gram begins where GRAM characters of the text are left
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
    starts = np.flatnonzero(left >= GRAM)
    keys = sum(points[starts + k] << (21 * (GRAM - 1 - k)) for k in range(GRAM))
    order = np.lexsort((owner[starts], keys))
    keys, owner = keys[order], owner[starts][order]
    new = np.diff(keys, prepend=-1) != 0
    once = new | (np.diff(owner, prepend=-1) != 0)
    keys, owner, new = keys[once], owner[once], np.flatnonzero(new[once])
    spelled = np.stack([(keys[new] >> (21 * (GRAM - 1 - k))) & 0x1FFFFF for k in range(GRAM)], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(owner)), pa.int32()), pa.array(owner, pa.int64()))
    found = [spelled[at : at + GRAM] for at in range(0, len(spelled), GRAM)]
    return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([field] * len(found), pa.int32()), lists], schema=_POSTINGS)


def _postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (_row, then one column of lower-case text per field)."""
    for batch in batches:
        rows = batch.column(0).to_numpy()
        for field in range(batch.num_columns - 1):
            texts = batch.column(field + 1).to_pylist()
            group = np.cumsum([len(text or "") for text in texts]) // _CHARACTERS
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
            for a, b in zip(edges, edges[1:]):
                yield _gram_lists(texts[a:b], rows[a:b], field)


def _bucket(row: str) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    rows_path: str
    postings_path: str
    fields: list[str]

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.rows_path)

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(self.postings_path)


def build_index(df: DataFrame, fields: list[str], path: str | None = None) -> SearchIndex:
    """Write ``df`` and the postings of its ``fields`` under a folder."""
    spark = df.sparkSession
    path = path or fresh_path(spark, "search")
    index = SearchIndex(spark, f"{path}/rows", f"{path}/postings", list(fields))
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    numbered.withColumn("_bucket", _bucket("_row")).repartition("_bucket").write.partitionBy("_bucket").parquet(index.rows_path)
    # from the rows as written, whose numbers stand still
    lowered = index.rows().select("_row", *[F.lower(F.col(f"`{name}`").cast("string")).alias(f"_{k}") for k, name in enumerate(fields)])
    # written once: ranges are found on a sample of the lists
    postings = settle(lowered.mapInArrow(_postings, "gram string, field int, rows array<bigint>"), "postings")
    postings.repartitionByRange("gram", F.xxhash64("rows")).sortWithinPartitions("gram", "field").write.parquet(index.postings_path)
    return index


def candidates(index: SearchIndex, word: str) -> DataFrame | None:
    """Numbers of the rows with all grams of ``word`` in one field; null if it has none."""
    wanted = index.spark.range(1).select(grams(F.lit(word)).alias("grams")).first().grams
    if not wanted:
        return None
    lists = index.postings().filter(F.col("gram").isin(wanted))
    hits = lists.select("field", F.explode("rows").alias("_row")).groupBy("field", "_row").agg(F.count("*").alias("n"))
    return hits.filter(F.col("n") == len(wanted)).select("_row").distinct()


def search(index: SearchIndex, word: str) -> DataFrame:
    """The rows with ``word`` in any field, upper and lower case alike."""
    hit = reduce(Column.__or__, [contains_ignoring_case(F.col(f"`{f}`").cast("string"), word) for f in index.fields])
    rows, found = index.rows(), candidates(index, word)
    if found is not None:
        found = settle(found, "candidates")
        # at most BUCKETS numbers; only these folders are read
        buckets = [r.b for r in found.select(_bucket("_row").alias("b")).distinct().collect()]
        rows = rows.filter(F.col("_bucket").isin(buckets)).join(found, "_row", "left_semi")
    return rows.filter(hit).drop("_row", "_bucket")
