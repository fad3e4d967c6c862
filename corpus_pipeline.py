"""From raw documents to packed sequences: five stages, each over all its predecessor kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``.  Between stages the table is written to the shared folder and read
again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bizlake.llm.common import documents
from bizlake.llm.copies import keep_first
from bizlake.llm.jaccard import keep_one
from bizlake.llm.languages import keep_known
from bizlake.llm.packing import pack_all
from bizlake.llm.privacy import sanitise_all
from bizlake.session import settle


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return keep_known(spark, docs, sf_dir)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return keep_first(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts stays."""
    return keep_one(spark, docs, sf_dir)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are masked; documents stay."""
    return sanitise_all(spark, docs, sf_dir)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences."""
    return pack_all(spark, docs, sf_dir)


STAGES = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("packing", packing),
]

#: The classifier, the corpus statistics and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
