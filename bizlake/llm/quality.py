"""Quality rules and an isolation forest over their statistics.

Every document gets rule statistics, written once.  A forest of random splits is
grown on all labelled rows, each dealt to one tree or more; short mean paths mark
anomalous documents.  The threshold is the one, on a grid of ``CELLS``, that best
tells all labelled rows apart while it keeps ``KEEP_GOOD`` of the good ones.

Defined cases: null is a text without words; such texts and those under
``MIN_WORDS`` words fail the rules; without labels of both kinds the forest
drops nothing.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .common import as_batch, chunks, documents

MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Trees, the rows that a tree gets at least where there are as many, its levels, and the steps of the threshold.
TREES, TREE_ROWS, DEPTH, CELLS = 100, 64, 8, 10_000
#: Steps between the trees of a row; none shares a factor with their number.
STEPS = [k for k in range(1, TREES) if np.gcd(k, TREES) == 1]
#: Share of good labelled rows that the threshold has to keep.
KEEP_GOOD = 0.995
SEED = 5

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbols", "upper", "repeats", "dup_lines", "word_length", "bare_ends"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS) + ", features array<float>"
ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in STATISTICS), ("features", pa.list_(pa.float32()))])


def measure(text: str) -> tuple[list[int], list[float]]:
    """The five statistics of a text, and the ratios that the forest splits on."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    dup_lines = len(lines) - len(set(lines))
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(tally := Counter(triples)) < len(triples):
        end = 0
        for i, triple in enumerate(triples):
            if tally[triple] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    upper = sum(map(str.isupper, text.split())) if text != text.lower() else 0
    features = [
        symbols / max(chars, 1), upper / max(n, 1), repeated / max(n, 1), dup_lines / max(len(lines), 1),
        chars / max(n, 1), sum(line[-1] not in ".!?\"')" for line in lines) / max(len(lines), 1),
    ]
    return [n, chars, symbols, dup_lines, repeated], features


def _measured(batches):
    for chunk in chunks(batches):
        rows = [measure(t or "") for t in chunk.column("text").to_pylist()]
        columns = {"doc_id": chunk.column("doc_id"), "features": [f for _, f in rows]}
        columns |= {c: [s[k] for s, _ in rows] for k, c in enumerate(STATISTICS)}
        yield as_batch(columns, ARROW)


def _usual(n: float) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(data: np.ndarray, times: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """A tree of random splits over distinct rows that stand so many ``times``, as flat arrays."""
    feature, cut, child, path = [], [], [], []

    def node(rows, level) -> int:
        k = len(feature)
        for column, value in ((feature, 0), (cut, np.inf), (child, (k, k)), (path, 0.0)):
            column.append(value)
        low, high = data[rows].min(axis=0), data[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if level == DEPTH or not len(usable):
            path[k] = level + _usual(times[rows].sum())
            return k
        f = int(rng.choice(usable))
        # above the lowest and up to the highest, so that both sides have rows
        at = max(rng.uniform(low[f], high[f]), np.nextafter(low[f], np.inf))
        left = data[rows, f] < at
        feature[k], cut[k] = f, at
        child[k] = (node(rows[left], level + 1), node(rows[~left], level + 1))
        return k

    node(np.arange(len(data)), 0)
    return [np.array(feature), np.array(cut), np.array(child), np.array(path)]


class IsolationForest:
    """Trees as :func:`grow` gives them, and the number of rows that a tree was grown on."""

    def __init__(self, trees: list[list[np.ndarray]], rows: float):
        self.trees, self.usual = trees, _usual(rows)

    def score(self, data: np.ndarray) -> np.ndarray:
        """Near 1 for rows that few splits set apart, under 0.5 for usual ones."""
        total = np.zeros(len(data))
        rows = np.arange(len(data))
        for feature, cut, child, path in self.trees:
            at = np.zeros(len(data), dtype=np.int64)
            for _ in range(DEPTH):
                at = child[at, (data[rows, feature[at]] >= cut[at]).astype(np.int64)]
            total += path[at]
        return 2.0 ** (-(total / len(self.trees)) / max(self.usual, 1e-9))


def _cell(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * CELLS).astype(np.int64)


def calibrate(good: np.ndarray, bad: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The last cell that is kept, from the rows of each cell of scores; inf if the labels can't tell."""
    if not good.sum() or not bad.sum():
        return float("inf")
    share = np.cumsum(good) / good.sum()
    gain = np.cumsum(good) / good.sum() - np.cumsum(bad) / bad.sum()
    allowed = np.flatnonzero(share >= keep_good)
    return float(allowed[int(np.argmax(gain[allowed]))])


def _features(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.array(table.column("features").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))


def fit(measured: DataFrame, labels: DataFrame) -> tuple[IsolationForest | None, float]:
    """Forest and last kept cell from all labelled documents with enough words."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    marked = marked.dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = measured.filter(F.col("n_words") >= MIN_WORDS).join(marked, "doc_id").select("doc_id", "features", (F.col("label") == 1).alias("good"))
    rows = settle(rows, "labelled")
    if (n := rows.count()) < 8:
        return None, float("inf")
    copies = min(TREES, -(-TREES * TREE_ROWS // n))
    # every row goes to ``copies`` trees; equal rows travel as one
    start = F.pmod(F.xxhash64("doc_id", "features", F.lit(SEED)), F.lit(TREES))
    step = F.element_at(F.array(*map(F.lit, STEPS)), (F.pmod(F.xxhash64("features", "doc_id"), F.lit(len(STEPS))) + 1).cast("int"))
    trees = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda k: F.pmod(start + k * step, F.lit(TREES)).cast("int"))
    dealt = rows.select(F.explode(trees).alias("tree"), "features").groupBy("tree", "features").agg(F.count("*").alias("times"))

    def grown(table: pa.Table) -> pa.Table:
        data, times = _features(table), table.column("times").to_numpy()
        order = np.lexsort(data.T)
        tree = table.column("tree")[0].as_py()
        feature, cut, child, path = grow(data[order], times[order], np.random.default_rng([SEED, tree]))
        return pa.table({"tree": pa.array([tree], pa.int32()), "feature": [feature], "cut": [cut], "child": [child.ravel()], "path": [path]})

    schema = "tree int, feature array<bigint>, cut array<double>, child array<bigint>, path array<double>"
    # at most TREES rows of 2 ** (DEPTH + 1) nodes
    found = dealt.groupBy("tree").applyInArrow(grown, schema).orderBy("tree").collect()
    forest = IsolationForest(
        [[np.array(r.feature), np.array(r.cut), np.array(r.child).reshape(-1, 2), np.array(r.path)] for r in found], n * copies / len(found)
    )

    def placed(batches):
        counts = np.zeros((2, CELLS + 1), dtype=np.int64)
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(counts, (good, _cell(forest.score(_features(batch)))), 1)
        good, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"good": good == 1, "cell": cell, "n": counts[good, cell]})

    counts = np.zeros((2, CELLS + 1), dtype=np.int64)
    for r in rows.select("good", "features").mapInArrow(placed, "good boolean, cell long, n long").groupBy("good", "cell").agg(F.sum("n").alias("n")).collect():
        counts[int(r.good), r.cell] = r.n
    return forest, calibrate(counts[1], counts[0])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, rule verdict, anomaly score and verdict of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    measured = settle(texts.mapInArrow(_measured, SCHEMA), "measured")
    forest, last = fit(measured, labels)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS) + ", base_failed boolean, kept boolean, anomaly double"
    arrow = pa.schema([*list(ARROW)[:-1], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("anomaly", pa.float64())])

    def run(batches):
        for batch in batches:
            n, repeats = (batch.column(c).to_numpy() for c in ("n_words", "n_repeat_words"))
            scores = forest.score(_features(batch)) if forest else np.zeros(len(n))
            failed = (n < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n)
            columns = {c: batch.column(c) for c in ("doc_id", *STATISTICS)}
            yield as_batch(columns | {"base_failed": failed, "kept": ~failed & (_cell(scores) <= last), "anomaly": scores}, arrow)

    return measured.mapInArrow(run, schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
