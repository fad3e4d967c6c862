"""Exact dedup by salted groups that compare whole texts.

Three stages, each grouping by digest *and* normalised text, so that only texts
equal in full meet: the map side of the first shuffle (rows of one task), groups
by (digest, salt, text), and groups by (digest, text) over the salts' winners.
A hot text reaches the salted stage as one row per task and the last stage as
one row per salt.

Documents find their winner by digest.  Should different texts ever share a
digest, those digests are matched by the text itself.

Defined cases: a null text counts as empty; all empty texts are one group;
rows with repeated ids are rows of their own; a null id stays only if no copy
has an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .common import SPACES, documents

#: Groups that the winners of one hot text are dealt to before they meet.
SALTS = 64


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _norm(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACES, " ")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = _sha256,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) per document.

    ``digest`` may be any function of the text; a weak one costs time, not
    correctness.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), _norm(text_col).alias("norm")).withColumn("digest", digest(F.col("norm")))
    salted = docs.groupBy("digest", (F.spark_partition_id() % SALTS).alias("salt"), "norm").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("n")
    )
    winners = salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # one row per digest; with two texts behind it, it is told apart by text below
    by_digest = settle(
        winners.groupBy("digest").agg(
            F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        ),
        "winners",
    )
    thin = docs.select("doc_id", "digest").join(by_digest.filter("texts = 1").drop("texts"), "digest")
    shared = by_digest.filter("texts > 1").select("digest")
    if not shared.isEmpty():
        apart = winners.join(shared, "digest", "left_semi")
        thin = thin.unionByName(docs.join(apart, ["digest", "norm"]).select(thin.columns))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return thin.select("doc_id", "keep_id", "group_size", first.alias("kept"), "digest")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(documents(spark, sf_dir))
    return groups.withColumnRenamed("digest", "text_sha256")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts one row with the smallest id stays.

    A null id equals a null id.  Rows are told by id and digest; where these
    repeat, the rows' hashes settle which one stays.
    """
    kept = exact_groups(docs).filter("kept").groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    kept = settle(kept.withColumnsRenamed({"doc_id": "id", "digest": "kept"}), "kept")
    # the row travels as one value, so that its column names meet no others
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _sha256(_norm("text")).alias("digest"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("kept"))
    single = keyed.join(kept.filter("n = 1"), same, "left_semi").select("row.*")
    repeated = kept.filter("n > 1")
    if repeated.isEmpty():
        return single
    first = keyed.join(repeated, same, "left_semi").groupBy("doc_id", "digest").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return single.unionByName(first.select("row.*"))
