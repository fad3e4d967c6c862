"""Phrase collocations from the counts of the longest windows alone.

Each word starts one window: itself and the words that follow it in its piece, in
lead columns, padded with empty strings beyond the piece's end.  Only these
longest windows are counted; a ROLLUP over their columns adds up the windows
that share a first word, first two words and so on, and gives the counts of
all shorter phrases, since every occurrence of a phrase is the start of exactly
one window.

A phrase cannot be more frequent than the phrases inside it.  Earlier passes count
single words, pairs and triples by 64-bit hashes alone, each where the one before
found enough; windows of the last pass end before the first word, pair or triple
that has too few, and so mostly fall together within a task.  What is frequent
travels as a bit field of fixed size.  Texts whose hashes or bits meet only make a
window longer than need be, whose exact count drops it later.

Cuts are scored in decimals of 38 digits: 1000 times a count times a corpus's
words must stay below 10^38, and a product of two counts too.

Defined cases: a null text counts as empty, a null lang as ``und``; texts may be of
any length (long ones are cut at breaks between pieces); repeated rows count
each; ties in the ranking are settled by the phrase, which is unique in its lang;
an empty table, or one without frequent phrases, gives no rows.  Other columns
may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import as_batch, documents, mix

#: Longest phrase, least occurrences, phrases reported per lang.
LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: A candidate goes when a longer one around it has this percent of its occurrences.
COVER_PERCENT = 100

#: Words of the widest phrases that are counted by hashes first.
SIEVES = 3
#: Bits of the field that knows frequent hashes; 4 MB whatever the corpus.
SIEVE_BITS = 1 << 25
#: Bits in one row while the field is put together; fixed by ``bitmap_construct_agg``.
BITMAP_BITS = 1 << 15
#: Bytes of text whose windows are combined in a task before they move.
CHUNK_BYTES = 4 << 20

BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: 0 for letters of words, 1 for blanks, 2 for breaks.
KIND = np.zeros(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2

STRIDE = np.uint64(0x9E3779B97F4A7C15)


def _columns(width: int) -> list[str]:
    return [f"w{k + 1}" for k in range(width)]


def _hashes(values: Iterable[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values), dtype=np.uint64)


def _holds(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes & np.uint64(SIEVE_BITS - 1)).astype(np.int64)
    return (sieve[place >> 3] >> (place & 7).astype(np.uint8) & 1) > 0


def _slices(text: bytes) -> Iterator[bytes]:
    """A text cut after breaks, so that no piece is cut."""
    at = 0
    while len(text) - at > CHUNK_BYTES and (found := BREAK.search(text, at + CHUNK_BYTES)):
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def _loads(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Langs and texts of about CHUNK_BYTES at a time."""
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            data = text.as_buffer()
            for part in _slices(data.to_pybytes()) if data else ():
                langs.append(lang)
                texts.append(part)
                size += len(part)
                if size >= CHUNK_BYTES:
                    yield langs, texts
                    langs, texts, size = [], [], 0
    if texts:
        yield langs, texts


class Words:
    """The words of several texts as numbers, with their text's lang and their piece."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        raw = b"\n".join(texts).translate(LOWER)
        kind = KIND[np.frombuffer(raw, dtype=np.uint8)]
        inside = np.concatenate([[False], kind == 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        breaks = np.flatnonzero(kind == 2)
        self.piece = np.searchsorted(breaks, start)
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        names, lang_of = np.unique(np.array(langs, dtype=object), return_inverse=True)
        self.langs = names.tolist()
        self.lang = lang_of[np.searchsorted(text_ends, start, side="right")]
        # the letters of all words without what lies between them
        letters = np.frombuffer(raw, dtype=np.uint8)[kind == 0]
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        coded = pc.dictionary_encode(column)
        self.id = coded.indices.to_numpy().astype(np.int64)
        self.values = coded.dictionary.to_pylist()
        langs_hashed = _hashes(name.encode() for name in self.langs)
        self.hash = mix(langs_hashed[self.lang] * STRIDE + _hashes(self.values)[self.id])

    def runs(self, sieves: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Per width the starts of runs whose inner runs are all frequent, as far as ``sieves`` tell.

        Also, for runs of one word more than there are sieves, those that may be
        frequent, and their hashes.
        """
        n = len(self.id)
        hashes, frequent = self.hash, []
        may_be = np.ones(n, dtype=bool)
        for width, sieve in enumerate(sieves, 1):
            frequent.append(may_be & _holds(sieve, hashes))
            may_be = frequent[-1][:-1] & frequent[-1][1:]
            if width == 1:
                may_be &= self.piece[1:] == self.piece[:-1]
            hashes = mix(hashes[:-1] * STRIDE + self.hash[width:])
        return frequent, may_be, hashes

    def hash_counts(self, sieves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and numbers of the runs one word wider than ``sieves`` know."""
        _, may_be, hashes = self.runs(sieves)
        return np.unique(hashes[may_be], return_counts=True)

    def windows(self, width: int, sieves: list[np.ndarray]) -> np.ndarray:
        """A row per frequent word: lang, then ids plus one of its window, 0 beyond the end."""
        n = len(self.id)
        frequent, _, _ = self.runs(sieves)
        table = np.zeros((n, width + 1), dtype=np.int64)
        table[:, 0], table[:, 1] = self.lang, self.id + 1
        goes_on = frequent[0]
        for k in range(1, min(width, n)):
            inner = min(k + 1, len(frequent))  # the widest known run that ends with this word
            ends = frequent[inner - 1][k + 1 - inner :]
            goes_on = goes_on[: len(ends)] & ends[: len(goes_on)]
            rows = np.flatnonzero(goes_on)
            table[rows, k + 1] = self.id[rows + k] + 1
        return table[frequent[0]]


def _combined(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each occurs."""
    key = np.zeros(len(table), dtype=np.int64)
    for column in table.T:
        _, key = np.unique(key * (column.max(initial=0) + 1) + column, return_inverse=True)
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return table[first], counts


def _fields(sieves: list[Broadcast]) -> list[np.ndarray]:
    return [np.frombuffer(sieve.value, dtype=np.uint8) for sieve in sieves]


def _hash_counts(batches, sieves: list[Broadcast]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("f", pa.int64())])
    for langs, texts in _loads(batches):
        words = Words(langs, texts)
        hashes, counts = words.hash_counts(_fields(sieves))
        yield as_batch({"lang": pa.nulls(len(hashes), pa.string()), "h": hashes.view(np.int64), "f": counts}, schema)
        if not sieves:  # all words of each lang, told by their missing hash
            yield as_batch({"lang": words.langs, "h": pa.nulls(len(words.langs), pa.int64()), "f": np.bincount(words.lang, minlength=len(words.langs))}, schema)


def hash_counts(texts: DataFrame, sieves: list[Broadcast]) -> DataFrame:
    """(lang, h, f): numbers of runs by hash; words by lang where the hash is null."""
    counts = texts.mapInArrow(lambda batches: _hash_counts(batches, sieves), "lang string, h long, f long")
    return counts.groupBy("lang", "h").agg(F.sum("f").alias("f"))


def _window_counts(batches, width: int, sieves: list[Broadcast]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), *((c, pa.string()) for c in _columns(width)), ("f", pa.int64())])
    for langs, texts in _loads(batches):
        words = Words(langs, texts)
        rows, counts = _combined(words.windows(width, _fields(sieves)))
        spelled = pa.array([b"", *words.values], type=pa.binary()).cast(pa.string())
        columns = {"lang": pa.array(words.langs, pa.string()).take(pa.array(rows[:, 0])), "f": counts}
        columns |= {c: spelled.take(pa.array(rows[:, k + 1])) for k, c in enumerate(_columns(width))}
        yield as_batch(columns, schema)


def window_counts(texts: DataFrame, width: int, sieves: list[Broadcast]) -> DataFrame:
    """(lang, w1 .., f): windows of (lang, text) rows, combined within chunks of a task only."""
    schema = ", ".join(["lang string", *(f"{c} string" for c in _columns(width)), "f long"])
    return texts.mapInArrow(lambda batches: _window_counts(batches, width, sieves), schema)


def sieve_of(frequent: DataFrame) -> Broadcast:
    """The bit field of the hashes ``h``; at most SIEVE_BITS / 8 bytes reach the driver."""
    place = F.col("h").bitwiseAND(SIEVE_BITS - 1)
    rows = frequent.groupBy((place / BITMAP_BITS).cast("int").alias("block")).agg(F.bitmap_construct_agg(place % BITMAP_BITS).alias("bits"))
    field = np.zeros(SIEVE_BITS // 8, dtype=np.uint8)
    step = BITMAP_BITS // 8
    for row in rows.collect():
        field[row.block * step : (row.block + 1) * step] = np.frombuffer(row.bits, dtype=np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(field.tobytes())


def phrase_counts(texts: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases with enough occurrences, and (lang, n)."""
    frequent = F.col("f") >= min_count
    sieves: list[Broadcast] = []
    totals = None
    for _ in range(SIEVES):
        found = settle(hash_counts(texts, sieves).filter(frequent | F.col("h").isNull()), "frequent")
        if totals is None:
            totals = found.filter("h is null").select("lang", F.col("f").alias("n"))
        sieves.append(sieve_of(found.filter("h is not null")))
    columns = _columns(longest)
    windows = window_counts(texts, longest, sieves)
    rolled = windows.rollup("lang", *columns).agg(F.sum("f").alias("f"), F.grouping_id().alias("level")).filter(frequent)
    # a level that sums over all but the first k words is a phrase of k words unless the last of these is padding
    width = longest - F.log2(F.col("level") + 1).cast("int")
    spelled = rolled.filter("lang is not null").withColumn("width", width).filter("width > 0")
    spelled = spelled.withColumn("words", F.slice(F.array(*columns), F.lit(1), F.col("width")))
    spelled = spelled.filter(F.element_at("words", -1) != "")
    return settle(spelled.select("lang", F.array_join("words", " ").alias("phrase"), "words", "f"), "phrases"), totals


def _joined(words: str, first, n) -> F.Column:
    return F.array_join(F.slice(F.col(words), first, n), " ")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST,
    min_count: int = MIN_COUNT, cover_percent: int = COVER_PERCENT, top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each lang."""
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    phrases, totals = phrase_counts(texts, longest, min_count)
    known = phrases.select("lang", "phrase", "f")
    several = phrases.filter(F.size("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"), F.size("words").alias("size"))
    # phrases inside longer ones; a part is at least as frequent as the whole
    inner = several.filter("size > 2").select("lang", "words", "a", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"), "size")
    inner = inner.select("lang", "words", "a", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("at"))
    covers = inner.groupBy("lang", _joined("words", F.col("at"), F.col("k")).alias("phrase")).agg(F.max("a").alias("cover"))
    kept = several.join(covers, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("cover") < cover_percent * F.col("a"), F.lit(True)))
    cuts = kept.select("lang", "phrase", "words", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _joined("words", F.lit(1), F.col("k")).alias("left"),
        _joined("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"),
    )
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    exact = "cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * 1000 div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    scored = cuts.withColumn("score", F.expr(exact))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = worst.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def _op13_sql() -> str:
    leads = ", ".join(f"lead(w, {k}) OVER (PARTITION BY doc, piece ORDER BY pos) AS w{k + 1}" for k in range(1, LONGEST))
    names = [" || ' ' || ".join(_columns(k)) for k in range(1, LONGEST + 1)]
    counts = " UNION ALL ".join(
        f"SELECT lang, {k + 1} AS size, {name} AS phrase, count(*) AS f, [{', '.join(_columns(k + 1))}] AS ws FROM x"
        f" WHERE w{k + 1} IS NOT NULL GROUP BY ALL" for k, name in enumerate(names)
    )
    inner = " UNION ALL ".join(
        f"SELECT lang, array_to_string(ws[{at}:{at + k - 1}], ' ') AS phrase, f FROM c WHERE size = {size}"
        for size in range(3, LONGEST + 1) for k in range(2, size) for at in range(1, size - k + 2)
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                  regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT doc, lang, unnest(range(len(pieces))) AS piece, unnest(pieces) AS t FROM d),
q AS (SELECT doc, lang, piece, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM p),
w AS (SELECT doc, lang, piece, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM q),
x AS (SELECT lang, w AS w1, {leads} FROM w),
g AS ({counts}),
c AS (SELECT * FROM g WHERE f >= 100),
tot AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
inn AS (SELECT lang, phrase, max(f) AS cover FROM ({inner}) GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN inn USING (lang, phrase) WHERE size > 1 AND NOT coalesce(100 * cover >= 100 * f, false)),
s AS (
  SELECT k.lang, k.phrase, k.f AS a, u.cut, lf.f AS l, rf.f AS r, n,
         (1000::HUGEINT * k.f * n) // (lf.f::HUGEINT * rf.f) AS score
  FROM k JOIN (SELECT unnest(range(1, {LONGEST})) AS cut) u ON u.cut < k.size
  JOIN c lf ON lf.lang = k.lang AND lf.phrase = array_to_string(k.ws[1:u.cut], ' ')
  JOIN c rf ON rf.lang = k.lang AND rf.phrase = array_to_string(k.ws[u.cut + 1:k.size], ' ')
  JOIN tot ON tot.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000
"""


OP13_SQL = _op13_sql()
