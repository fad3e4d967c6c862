"""How filters interact: what each order of filters removes at each step.

Every document gets one bit per filter it fails, and all that follows needs only
the number of documents per (part, bits), summed before they move.  A walk over
the subsets of filters in Gray-code order switches one filter at a time.  Each
cell of the table of bits counts how many active filters it fails; when that
count leaves or reaches zero, the cell's documents leave or join the running
survivors.  The states of all subsets are stored once, and every step of every
order is the difference of two of them.

A text is a repeat when the same text has a smaller id anywhere in the table:
least ids per digest of the text, joined back to thin rows, so a hot text is
summed before it moves and its rows can be split.

Defined cases: a null text counts as empty and a null part as the empty string;
no words, or no characters, fail neither share rule; a null id has no labels, is no repeat and makes none;
rows that repeat an id and a text are not repeats of each other; of
several labels of a document the highest counts; an empty table has no parts and
no rows.  Columns other than the named ones may have any name.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .common import SPACES, as_batch, documents

#: Production limits: least words, percent of distinct words, percent of capitals, symbols.
MIN_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
SYMBOLS = r"[#$%&*|]"

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n", "good", "toxic")

#: Parts whose rows one Arrow batch holds.
PARTS_PER_BATCH = 64

SCHEMA = """part string, filter_order string, step int, kept long, removed long, redundant long,
            unique_fails long, good_lost long, toxic_lost long, shapley long"""
ARROW = pa.schema([
    ("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()),
    *((c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")),
])


def text_failures(docs: DataFrame, part_col: str, id_col: str, text_col: str) -> DataFrame:
    """(part, doc_id, digest, A, B, C, D): the conditions that one text alone decides."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text")
    )
    rows = rows.withColumn("words", F.filter(F.split("text", SPACES), lambda word: word != ""))
    rows = rows.withColumn("n", F.size("words")).withColumn("distinct", F.size(F.array_distinct("words")))
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    return rows.select(
        "part", "doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        (F.col("n") < MIN_WORDS).alias("A"),
        (100 * F.col("distinct") < DISTINCT_PERCENT * F.col("n")).alias("B"),
        (100 * capitals > CAPITAL_PERCENT * F.length("text")).alias("C"),
        F.col("text").rlike(SYMBOLS).alias("D"),
    )


def with_repeats(rows: DataFrame, name: str = "E") -> DataFrame:
    """``rows`` (doc_id, digest, ...) with a flag for digests that a smaller id has too."""
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).filter("copies > 1")
    joined = rows.join(firsts.drop("copies"), "digest", "left")
    return joined.withColumn(name, F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("least", "digest")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with 1 or 0 for the labels of their document."""
    one = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("long"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    return rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])


def cells(rows: DataFrame, filters: str) -> DataFrame:
    """(part, cells): per part the counts of every set of failed filters that occurs."""
    mask: Column = sum((F.col(f).cast("int") * (1 << k) for k, f in enumerate(filters)), F.lit(0))
    summed = rows.groupBy("part", mask.alias("mask")).agg(
        F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )
    # at most two to the number of filters rows per part
    return summed.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))


def gray_walk(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters; one row per part, cells and subsets by their bits."""
    n_sets = cells.shape[1]
    sets = np.arange(n_sets)
    failures = np.zeros(n_sets, dtype=np.int64)
    states = np.zeros_like(cells)
    running = cells.sum(axis=1)
    states[:, 0] = running
    subset = 0
    for step in range(1, n_sets):
        bit = step & -step  # the one filter that changes
        subset ^= bit
        touched = (sets & bit) > 0
        if subset & bit:
            running = running - cells[:, touched & (failures == 0)].sum(axis=1)
            failures[touched] += 1
        else:
            failures[touched] -= 1
            running = running + cells[:, touched & (failures == 0)].sum(axis=1)
        states[:, subset] = running
    return states


def _steps(filters: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order, step, filter and the active bits before and after, of each step of each order."""
    orders, step, which, before = [], [], [], []
    for order in permutations(range(len(filters))):
        active = 0
        for k, f in enumerate(order):
            orders.append("".join(filters[i] for i in order))
            step.append(k + 1)
            which.append(f)
            before.append(active)
            active |= 1 << f
    which, before = np.array(which), np.array(before)
    return orders, np.array(step), which, before, before | (1 << which)


def _audit(batches, filters: str):
    orders, step, which, before, after = _steps(filters)
    n_sets = 1 << len(filters)
    for batch in (b.slice(at, PARTS_PER_BATCH) for b in batches for at in range(0, b.num_rows, PARTS_PER_BATCH)):
        parts = batch.column("part").to_pylist()
        table = {c: np.zeros((len(parts), n_sets), dtype=np.int64) for c in COUNTS}
        for row, found in enumerate(batch.column("cells").to_pylist()):
            for cell in found:
                for c in COUNTS:
                    table[c][row, cell["mask"]] = cell[c]
        states = {c: gray_walk(table[c]) for c in COUNTS}
        lost = {c: states[c][:, before] - states[c][:, after] for c in COUNTS}
        sets = np.arange(n_sets)
        failing = np.stack([table["n"][:, (sets >> f & 1) > 0].sum(axis=1) for f in range(len(filters))], axis=1)
        shapley = np.stack([lost["n"][:, which == f].sum(axis=1) for f in range(len(filters))], axis=1)
        yield as_batch({
            "part": np.repeat(np.array(parts, dtype=object), len(orders)), "filter_order": orders * len(parts), "step": np.tile(step, len(parts)),
            "kept": states["n"][:, after].ravel(), "removed": lost["n"].ravel(),
            "redundant": (failing[:, which] - lost["n"]).ravel(), "unique_fails": table["n"][:, 1 << which].ravel(),
            "good_lost": lost["good"].ravel(), "toxic_lost": lost["toxic"].ravel(), "shapley": shapley[:, which].ravel(),
        }, ARROW)


def audit(rows: DataFrame, filters: str) -> DataFrame:
    """One row per part, order of ``filters`` and step, from rows with a flag per filter.

    ``rows`` has part, one boolean column per letter of ``filters`` (true: fails),
    good and toxic (1 or 0).
    """
    return cells(rows, filters).mapInArrow(lambda batches: _audit(batches, filters), SCHEMA)


def audit_documents(
    docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The audit of the five production filters over whole texts."""
    thin = settle(text_failures(docs, part_col, id_col, text_col), "failures")
    return audit(with_labels(with_repeats(thin), labels), "ABCDE")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _orders_sql() -> str:
    orders, step, which, before, _ = _steps("ABCDE")
    return ", ".join(f"('{o}', {s}, {b}, {1 << f})" for o, s, f, b in zip(orders, step, which, before))


OP11_SQL = rf"""
WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
m AS (
  SELECT part, doc_id,
         (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask
  FROM w),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
o(filter_order, step, bef, bit) AS (VALUES {_orders_sql()}),
r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (bef | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bef = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bef > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bef = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bef = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c CROSS JOIN o GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
