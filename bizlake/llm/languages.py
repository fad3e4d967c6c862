"""Language ID as a mixture of languages per document.

Each language has a model of character n-grams (one to three letters of words
with their ends marked), counted over a bounded sample of its documents.  Words
get a likelihood under every language; expectation maximisation finds the
proportions of languages in a document, and languages are left out one by one
as long as the likelihood, less a penalty per language, does not fall.

Defined cases: null, empty and letterless texts are ``und`` with score 0;
equal proportions go to the first name; without training rows all is ``und``.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_batch, chunks, documents, held_out

MODULUS = 4
#: Documents of a language that its model is counted on, and n-grams it keeps.
SAMPLE_DOCS, GRAMS = 600, 60_000
#: Documents of all languages together; with many languages each gets an equal part.
SAMPLE_ALL = 100_000
SIZES = (1, 2, 3)
SMOOTHING = 0.5
ROUNDS = 8
#: Log-likelihood that a further language must bring, times the log of the words.
PENALTY = 2.0
WORDS_KEPT = 400_000
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Numerals such as fractions and raised digits, which the pattern also finds, are none."""
    return any(found[0].isalpha() for found in LETTER.finditer(text))


def grams(word: str) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1)]


def _counted(batches):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
    for chunk in chunks(batches):
        words: dict[str, Counter] = {}
        for lang, text in zip(chunk.column("lang").to_pylist(), chunk.column("text").to_pylist()):
            words.setdefault(lang, Counter()).update(text.lower().split())
        for lang, tally in words.items():
            found: Counter = Counter()
            for word, n in tally.items():
                for g in grams(word):
                    found[g] += n
            yield as_batch({"lang": [lang] * len(found), "gram": list(found), "n": list(found.values())}, schema)


class Model:
    """Log-likelihoods of n-grams by language; n-grams it has not met say nothing."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.languages = sorted({lang for lang, _, _ in counts})
        self.index: dict[str, int] = {}
        place = {lang: k for k, lang in enumerate(self.languages)}
        cells = [(self.index.setdefault(g, len(self.index)), place[lang], n) for lang, g, n in counts]
        table = np.zeros((len(self.index), len(self.languages)))
        for g, lang, n in cells:
            table[g, lang] += n
        sizes = np.array([len(g) for g in self.index], dtype=np.int64)
        self.table = np.zeros((len(self.index) + 1, len(self.languages)), dtype=np.float32)
        for n in SIZES:  # each length is a distribution of its own
            rows = np.flatnonzero(sizes == n)
            if len(rows):
                own = table[rows] + SMOOTHING
                self.table[rows] = np.log(own / own.sum(axis=0))
        # what all languages share tells nothing, so the best stands at 0
        if self.languages:
            self.table[:-1] -= self.table[:-1].max(axis=1, keepdims=True)

    def words(self, words: list[str]) -> np.ndarray:
        """Relative log-likelihood of each word under each language, a mean over n-gram lengths."""
        get, none = self.index.get, len(self.index)
        found = [[get(g, none) for g in grams(w)] for w in words]
        count = np.array([len(f) for f in found])
        flat = np.concatenate([np.array(f, dtype=np.int64) for f in found])
        sums = np.add.reduceat(self.table[flat], np.cumsum(count) - count, axis=0) / len(SIZES)
        return sums - sums.max(axis=1, keepdims=True)


def mixtures(like: np.ndarray, doc: np.ndarray, docs: int, penalty: float = PENALTY) -> np.ndarray:
    """Proportions of languages in each document; languages left out have 0.

    ``like`` holds a row of relative log-likelihoods per word, ``doc`` its document.
    """
    langs = like.shape[1]
    if not langs or not len(like):
        return np.zeros((docs, langs))
    telling = (like < 0).any(axis=1)
    like, doc = like[telling], doc[telling]
    chance = np.exp(np.maximum(like, -60.0)).astype(np.float32)
    n = np.bincount(doc, minlength=docs).astype(np.float64)

    def maximise(share: np.ndarray, rows: np.ndarray, of: np.ndarray, total: np.ndarray, rounds: int):
        for _ in range(rounds):
            joint = rows * share[of].astype(np.float32)
            whole = np.maximum(joint.sum(axis=1, keepdims=True), np.float32(1e-30))
            part = joint / whole
            got = np.stack([np.bincount(of, part[:, k], len(share)) for k in range(langs)], axis=1)
            share = got / np.maximum(total, 1)[:, None]
        whole = np.maximum((rows * share[of].astype(np.float32)).sum(axis=1), np.float32(1e-30))
        return share, np.bincount(of, np.log(whole.astype(np.float64)), len(share))

    share, fit = maximise(np.full((docs, langs), 1 / max(langs, 1)), chance, doc, n, ROUNDS)
    open_ = n > 0
    for _ in range(langs - 1):
        # leave out the smallest language of every document that still changes
        kept = share > 0
        open_ &= kept.sum(axis=1) > 1
        if not open_.any():
            break
        rows = open_[doc]
        number = np.cumsum(open_) - 1
        some = np.flatnonzero(open_)
        least = np.where(kept[some], share[some], np.inf).argmin(axis=1)
        trial = share[some].copy()
        trial[np.arange(len(some)), least] = 0
        trial /= np.maximum(trial.sum(axis=1, keepdims=True), 1e-30)
        trial, less = maximise(trial, chance[rows], number[doc[rows]], n[some], ROUNDS // 2)
        better = fit[some] - less <= penalty * np.log(n[some] + 1)
        share[some[better]], fit[some[better]] = trial[better], less[better]
        open_[some[~better]] = False
    share[n == 0] = 0
    return share


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Model from at most ``sample_docs`` documents of every language, none held out.

    The ids are drawn per language by a hash and joined to the texts as a table of
    at most ``SAMPLE_ALL`` rows, so no text moves but those of the sample.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", MODULUS))
    languages = rows.agg(F.countDistinct("lang")).first()[0]
    each = max(1, min(sample_docs, SAMPLE_ALL // max(languages, 1)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = rows.select("doc_id", "lang").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= each).drop("k")
    picked = rows.join(F.broadcast(drawn.distinct().limit(SAMPLE_ALL)), ["doc_id", "lang"])
    counts = picked.select("lang", "text").mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("k", F.row_number().over(top)).filter(F.col("k") <= GRAMS)
    return Model([(r.lang, r.gram, r.n) for r in best.orderBy("lang", "k").collect()])  # at most GRAMS rows a language


class _Words:
    """Mixtures of texts, with a bounded table of words met before."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.held = np.zeros((0, len(model.languages)), dtype=np.float32)

    def __call__(self, texts: list[str | None]) -> tuple[list[bool], np.ndarray]:
        """Which texts have a letter, and the proportions of languages in each."""
        model = self.model
        known = [bool(model.languages) and has_letter(t or "") for t in texts]
        words = [t.lower().split() if k else [] for t, k in zip(texts, known)]
        if len(self.place) > WORDS_KEPT:
            self.place, self.held = {}, self.held[:0].copy()
        place = self.place
        new = list({w for t in words for w in t if w not in place})
        if new:
            place.update(zip(new, range(len(place), len(place) + len(new))))
            self.held = np.concatenate([self.held, model.words(new)])
        sizes = [len(t) for t in words]
        at = np.fromiter((place[w] for t in words for w in t), np.int64, sum(sizes))
        share = mixtures(self.held[at], np.repeat(np.arange(len(texts)), sizes), len(texts))
        for k in np.flatnonzero(known):
            if not share[k].any():
                share[k] = 1 / share.shape[1]
        return known, share


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, languages): the main language, its proportion, all proportions."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
        ("languages", pa.map_(pa.string(), pa.float64())),
    ])

    def run(batches):
        mixed = _Words(model)
        for chunk in chunks(batches):
            columns: dict[str, list] = {f.name: [] for f in schema}
            for i, k, p in zip(chunk.column("doc_id").to_pylist(), *mixed(chunk.column("text").to_pylist())):
                columns["doc_id"].append(i)
                columns["lang_pred"].append(model.languages[int(p.argmax())] if k else UNKNOWN)
                columns["score"].append(min(float(p.max()), 1.0) if k else 0.0)
                columns["languages"].append([(name, float(x)) for name, x in zip(model.languages, p) if x > 0] if k else [])
            yield as_batch(columns, schema)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double, languages map<string,double>")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out("doc_id", MODULUS).alias("held_out"), "lang_pred", "score")


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language can't be told go."""
    model = learn(docs)

    def run(batches):
        mixed = _Words(model)
        for chunk in chunks(batches):
            known, share = mixed(chunk.column("text").to_pylist())
            yield chunk.filter(pa.array([k and bool(p.any()) for k, p in zip(known, share)], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
