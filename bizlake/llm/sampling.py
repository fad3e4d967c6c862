"""Bounded samples of labelled rows, the only rows a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep: Column | None = None) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents, picked by a hash of the id.

    The ids are drawn first and joined to the texts as a table of at most
    ``rows`` rows, so no text moves but those of the sample.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marked = marked.dropna().filter(keep if keep is not None else F.lit(True)).groupBy("doc_id").agg(F.max("label").alias("label"))
    drawn = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id")
