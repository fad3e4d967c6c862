"""Toxicity by bags of subwords.

A word is the mean of the vectors of its character n-grams, a stretch of
``STRETCH`` words the mean of its words, and a linear softmax tells toxic
stretches from others.  Vectors and softmax are trained together in numpy: first
every stretch carries its document's label, then only the stretches that score
highest in their document.  A document scores by its highest stretch, put
through a logistic curve fitted on the training rows.

Misspelt words share n-grams with the words they come from.

Defined cases: null is empty; empty texts have the score of a text without any
evidence; without labels of both kinds every score is the share of toxic rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, chunks, documents, held_out, ragged
from .sampling import labelled_sample

SAMPLE_ROWS = 4000
#: Hashed n-grams, their lengths, numbers in a vector, words in a stretch, steps between stretches.
SLOTS, SIZES, WIDTH, STRETCH, STEP = 1 << 16, (3, 4, 5, 6), 8, 16, 8
#: Steps of 512 stretches over everything before the highest ones are picked.
ROUNDS = 200
SEED, MODULUS = 7, 4
#: Training texts that an n-gram has to occur in.
LEAST = 4
#: How many usual gradients a weight counts as seen from the start.
FLOOR = 3.0
#: Words that a worker's table holds before it starts anew.
WORDS_KEPT = 400_000
#: Letters of words whose n-grams are hashed at a time; a longer word is hashed alone.
LETTERS = 1 << 20
#: Odd numbers that hashes are multiplied by: a letter's step, and the last mixing.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
CUT = 0.3


def _slot(h: np.ndarray, size: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX + np.uint64(size)
    return ((h * BASE) >> np.uint64(48)).astype(np.int64) % SLOTS


def _hashed(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(length)
    owner = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(codes))
    room = ends[owner] - at
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(SIZES) + 1):
        m = max(len(h) - n + 1, 0)
        h[:m] = h[:m] * BASE + codes[n - 1 :]
        if n in SIZES:
            inside = room >= n
            yield owner[inside], _slot(h[inside], n)
    powers = np.cumprod(np.full(int(length.max()), BASE))
    yield np.arange(len(words)), _slot(np.add.reduceat(codes * powers[at - (ends - length)[owner]], ends - length), 0)


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word's number, slot) of the n-grams of letters of the words with their ends marked, and of the words themselves."""
    begin, letters = 0, 0
    for k, word in enumerate(words):
        if letters and letters + len(word) > LETTERS:
            yield from ((owner + begin, slot) for owner, slot in _hashed(words[begin:k]))
            begin, letters = k, 0
        letters += len(word) + 2
    if begin < len(words):
        yield from ((owner + begin, slot) for owner, slot in _hashed(words[begin:]))


def _means(words: list[str], part: np.ndarray) -> np.ndarray:
    """Mean of ``part`` over the n-grams of each word."""
    total, count = np.zeros(len(words)), np.zeros(len(words))
    for owner, slot in grams(words):
        total += np.bincount(owner, part[slot], len(words))
        count += np.bincount(owner, minlength=len(words))
    return total / np.maximum(count, 1)


def stretches(n: int) -> np.ndarray:
    """First words of the stretches of a text of n words; the last one reaches its end."""
    if n <= STRETCH:
        return np.zeros(min(n, 1), dtype=np.int64)
    return np.unique(np.append(np.arange(0, n - STRETCH, STEP), n - STRETCH))


def fresh(words: np.ndarray) -> np.ndarray:
    """False for a word that stood less than a stretch ago; repeating a word adds nothing."""
    order = np.argsort(words, kind="stable")
    again = (words[order[1:]] == words[order[:-1]]) & (order[1:] - order[:-1] < STRETCH)
    out = np.ones(len(words), dtype=bool)
    out[order[1:][again]] = False
    return out


class Model:
    """n-gram vectors and softmax weights; a word's part in the logit is a single number."""

    def __init__(self, rng: np.random.Generator):
        self.vectors = rng.normal(0, 0.01, (SLOTS + 1, WIDTH)).astype(np.float32)
        self.vectors[SLOTS] = 0  # stands for n-grams of too few documents
        self.weights = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        self.slope, self.shift = 1.0, 0.0
        self._seen = {id(x): (np.zeros_like(x), np.zeros(())) for x in (self.vectors, self.weights, self.bias)}

    def part(self) -> np.ndarray:
        """What each n-gram adds to the logit of toxic over not toxic."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0])

    def train(self, words: np.ndarray, length: np.ndarray, sizes: np.ndarray, slots: np.ndarray, first: np.ndarray, count: np.ndarray, labels: np.ndarray, rate: float) -> None:
        """One step over stretches given as rows of word numbers (-1: none) and their lengths."""
        real = words >= 0
        flat = words[real]
        n_words = real.sum(axis=1)
        many = count[flat]
        slot = slots[ragged(first[flat], many)]
        weight = np.repeat((1.0 / many / np.repeat(length, n_words)).astype(np.float32), many)
        row = np.repeat(np.repeat(np.arange(len(words)), n_words), many)
        each = self.vectors[slot] * weight[:, None]
        sums = np.concatenate([np.zeros((1, WIDTH)), np.cumsum(each, axis=0, dtype=np.float64)])
        ends = np.cumsum(np.bincount(row, minlength=len(words)))
        bags = (sums[ends] - sums[np.concatenate([[0], ends[:-1]])]).astype(np.float32)
        logits = bags @ self.weights + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        error = p
        error[np.arange(len(words)), labels] -= 1
        error *= sizes[:, None] / sizes.sum()
        back = (error @ self.weights.T)[row] * weight[:, None]
        used, inverse = np.unique(slot, return_inverse=True)
        grad = np.stack([np.bincount(inverse, back[:, k], len(used)) for k in range(WIDTH)], axis=1).astype(np.float32)
        grad[used == SLOTS] = 0
        for values, at, g in ((self.weights, slice(None), bags.T @ error), (self.bias, slice(None), error.sum(axis=0)), (self.vectors, used, grad)):
            # steps shrink with what a weight has seen; a common floor keeps rare n-grams from jumping
            seen, floor = self._seen[id(values)]
            seen[at] += g * g
            floor += (g * g).mean()
            values[at] -= rate * g / np.sqrt(seen[at] + FLOOR * floor + 1e-20)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -30, 30)))


def _evidence(parts: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
    """Highest logit among the stretches of a text, and all of them."""
    n = len(parts)
    if not n:
        return bias, np.full(1, bias)
    sums = np.concatenate([[0.0], np.cumsum(np.where(fresh(parts), parts, 0), dtype=np.float64)])
    first = stretches(n)
    logits = bias + (sums[np.minimum(first + STRETCH, n)] - sums[first]) / min(n, STRETCH)
    return float(logits.max()), logits


class _Bags:
    """Training texts as numbers: words, their n-grams, and stretches of words."""

    def __init__(self, texts: list[str]):
        index: dict[str, int] = {}
        self.texts = [np.array([index.setdefault(w, len(index)) for w in t.lower().split()], dtype=np.int64) for t in texts]
        found = [np.concatenate(x) for x in zip(*grams(list(index)))] or [np.empty(0, np.int64)] * 2
        order = np.argsort(found[0], kind="stable")
        self.slots = found[1][order]
        self.count = np.bincount(found[0], minlength=len(index))
        self.first = np.cumsum(self.count) - self.count
        met = np.zeros(SLOTS + 1, dtype=np.int64)
        for text in self.texts:
            own = np.unique(text)
            met[np.unique(self.slots[ragged(self.first[own], self.count[own])])] += 1
        self.common = met >= LEAST
        self.slots = np.where(self.common[self.slots], self.slots, SLOTS)
        starts = [stretches(len(t)) for t in self.texts]
        self.owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        new = [fresh(t) for t in self.texts]
        self.length = np.ones(len(self.owner), dtype=np.int64)
        self.table = np.full((len(self.owner), STRETCH), -1, dtype=np.int64)
        for k, (d, s) in enumerate(zip(self.owner, np.concatenate(starts))):
            piece = self.texts[d][s : s + STRETCH]
            self.table[k, : len(piece)] = np.where(new[d][s : s + STRETCH], piece, -1)
            self.length[k] = len(piece)

    def words(self, model: Model) -> np.ndarray:
        return np.add.reduceat(model.part()[self.slots], self.first) / self.count if len(self.count) else np.empty(0)

    def evidence(self, model: Model) -> np.ndarray:
        each, bias = self.words(model), float(model.bias[1] - model.bias[0])
        return np.array([_evidence(each[t], bias)[0] for t in self.texts])


def _trained(bags: _Bags, labels: np.ndarray, rng: np.random.Generator) -> Model:
    model = Model(rng)
    model.vectors[~bags.common] = 0
    table, owner = bags.table, bags.owner
    # both labels weigh the same, and so do the documents within a label
    share = np.where(labels == 1, 1 / max(labels.sum(), 1), 1 / max((1 - labels).sum(), 1))
    size = (share / np.maximum(np.bincount(owner, minlength=len(labels)), 1))[owner]

    def turn(chosen: np.ndarray, weight: np.ndarray, rate: float) -> None:
        for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 512)):
            model.train(table[part], bags.length[part], weight[part], bags.slots, bags.first, bags.count, labels[owner[part]], rate)

    rounds = max(1, round(ROUNDS * 512 / max(len(owner), 1)))
    for _ in range(rounds):
        turn(np.arange(len(owner)), size, 0.3)
    for _ in range(2 * rounds):  # of each document only the highest stretches: two of toxic ones, six of others
        scored = np.where(table >= 0, bags.words(model)[np.maximum(table, 0)], 0).sum(axis=1) / bags.length
        order = np.lexsort((-scored, owner))
        rank = np.empty(len(owner), dtype=np.int64)
        rank[order] = np.arange(len(owner)) - np.searchsorted(owner, owner)
        turn(np.flatnonzero(rank < np.where(labels[owner] == 1, 2, 6)), share[owner], 0.2)
    return model


def _curve(x: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of the labels over x, by Newton steps."""
    center, scale = x.mean(), x.std() + 1e-9
    z, a, b = (x - center) / scale, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - labels) * z).sum() + 0.01 * a, (p - labels).sum()])
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return float(a / scale), float(b - a * center / scale)


def fit(rows: list[tuple[str, int]], seed: int = SEED) -> Model:
    """Model from (text, label) pairs, with the logistic curve of the same rows."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, y in rows], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        model = Model(rng)
        prior = float(labels.mean()) if len(rows) else 0.0
        model.slope, model.shift = 0.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
        return model
    bags = _Bags([t for t, _ in rows])
    model = _trained(bags, labels, rng)
    model.slope, model.shift = _curve(bags.evidence(model), labels)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    part, bias = model.part().astype(np.float64), float(model.bias[1] - model.bias[0])
    slope, shift = model.slope, model.shift
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        known: dict[str, float] = {}
        for chunk in chunks(batches):
            evidence = []
            if len(known) > WORDS_KEPT:
                known.clear()
            texts = [t.lower().split() for t in chunk.column("text").to_pylist()]
            new = list({w for t in texts for w in t if w not in known})
            if new:
                known.update(zip(new, _means(new, part).tolist()))
            for t in texts:
                evidence.append(_evidence(np.fromiter(map(known.__getitem__, t), np.float64, len(t)), bias)[0])
            scores = 1 / (1 + np.exp(-np.clip(slope * np.array(evidence) + shift, -30, 30)))
            yield as_batch({"doc_id": chunk.column("doc_id"), "score": scores}, schema)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double")


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out."""
    sample = labelled_sample(docs, labels, "toxic", rows, ~held_out("doc_id", MODULUS))
    return fit([(r.text, r.label) for r in sample.orderBy("doc_id", "text").toLocalIterator()])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select(
        "doc_id", held_out("doc_id", MODULUS).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
