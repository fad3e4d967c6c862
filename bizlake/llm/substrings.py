"""Substring dedup by super-k-mers.

A window is ``WINDOW`` consecutive words.  Its minimiser is the least hash among
its runs of ``MER`` words; consecutive windows that share it travel as one
string to the minimiser's bucket, so a bucket sees every copy of its windows.
There the windows are sorted by hash, neighbours are compared byte by byte, and
those found more than once send back the words they cover.

Hot minimisers are found by counting all windows per slot beforehand; their
windows travel one by one, dealt by their whole content.  Strings that repeat
within a task travel once with all their places.

Defined cases: null and empty texts, and texts of fewer than ``WINDOW`` words,
lose nothing; repeated rows are copies of each other and lose all their windows;
rows are told apart by id and text, so ids may repeat or be null.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    NO_ID, WordBuffer, as_batch, by_key, chunks, documents, keyed_text, mix, parts_for, ragged,
    sliding_min, squeeze, text_bytes, unsqueeze,
)

WINDOW, MER = 35, 4
#: Slots that minimisers are counted in.
SLOTS = 1 << 16
#: Bytes of strings in one bucket, and in a task before it hands its blobs on.
BUCKET_BYTES, FLUSH_BYTES = 4 << 20, 32 << 20
#: Bytes of strings for a byte of text, as windows overlap.
SPREAD = 3.2
#: Words of a long text that are handled at a time.
SEGMENT = 200_000

BLOBS = pa.schema([("bucket", pa.int64()), ("strings", pa.binary()), ("places", pa.binary())])
COUNTS = pa.schema([("slot", pa.int32()), ("windows", pa.int64())])
RANGES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
    ("kept_sha256", pa.string()), ("kept_text", pa.string()),
])


def _runs(batch: pa.RecordBatch):
    """Buffer, runs as (first window, last window), minimisers and places of a chunk."""
    segments, doc, text_hash, first = [], [], [], []
    for i, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))):
        words = text.encode().split()
        for a in range(0, len(words) - WINDOW + 1, SEGMENT):
            segments.append(b" ".join(words[a : a + SEGMENT + WINDOW - 1]))
            doc.append(NO_ID if i is None else i)
            text_hash.append(h)
            first.append(a)
    if not segments:
        return None
    buffer = WordBuffer(segments)
    word = buffer.hashes(buffer.start, buffer.end)
    mers = word[: len(word) - MER + 1].copy()
    for j in range(1, MER):
        mers = mix(mers) + word[j : len(word) - MER + 1 + j]
    least = sliding_min(mix(mers), WINDOW - MER + 1)
    piece = buffer.piece
    whole = piece[: len(least)] == piece[WINDOW - 1 :]
    turn = np.ones(len(least), dtype=bool)
    turn[1:] = (least[1:] != least[:-1]) | ~whole[:-1]
    a = np.flatnonzero(whole & turn)
    stop = np.ones(len(least), dtype=bool)
    stop[:-1] = turn[1:] | ~whole[1:]
    b = np.flatnonzero(whole & stop)
    opens = np.searchsorted(piece, np.arange(len(segments)))
    of = piece[a]
    at = np.array(first, dtype=np.int64)[of] + a - opens[of]
    return buffer, a, b, mix(least[a]), np.array(doc, dtype=np.int64)[of], np.array(text_hash, dtype=np.int64)[of], at


def _count_slots(batches):
    """Windows per slot, strings that repeat in a chunk counted once."""
    total = np.zeros(SLOTS, dtype=np.int64)
    for chunk in chunks(batches):
        if (found := _runs(chunk)) is None:
            continue
        buffer, a, b, least, *_ = found
        content = buffer.hashes(buffer.start[a], buffer.end[b + WINDOW - 1])
        _, one = np.unique(content, return_index=True)
        total += np.bincount((least[one] % np.uint64(SLOTS)).astype(np.int64), weights=(b - a + 1)[one], minlength=SLOTS).astype(np.int64)
    full = np.flatnonzero(total)
    yield as_batch({"slot": full.astype(np.int32), "windows": total[full]}, COUNTS)


def _pack(hot: np.ndarray, buckets: int):
    """Task that sends each run to the bucket of its minimiser, hot ones window by window."""

    def run(batches):
        held: dict[int, tuple[dict, array]] = {}
        size = 0
        for chunk in chunks(batches):
            if (found := _runs(chunk)) is None:
                continue
            buffer, a, b, least, doc, text_hash, at = found
            slot = (least % np.uint64(SLOTS)).astype(np.int64)
            burning = hot[slot]
            bucket = (least % np.uint64(SLOTS * buckets) // np.uint64(SLOTS)).astype(np.int64)
            if burning.any():
                n = np.where(burning, b - a + 1, 1)
                source = np.repeat(np.arange(len(a)), n)
                step = ragged(np.zeros(len(n), dtype=np.int64), n)
                one = burning[source]
                a2 = a[source] + step
                b2 = np.where(one, a2, b[source])
                whole = buffer.hashes(buffer.start[a2], buffer.end[b2 + WINDOW - 1])
                bucket = np.where(one, (whole % np.uint64(buckets)).astype(np.int64), bucket[source])
                a, b, doc, text_hash, at = a2, b2, doc[source], text_hash[source], at[source] + step
            raw = buffer.raw
            for s, e, k, i, h, f in zip(
                buffer.start[a].tolist(), buffer.end[b + WINDOW - 1].tolist(), bucket.tolist(),
                doc.tolist(), text_hash.tolist(), at.tolist(),
            ):
                if (mine := held.get(k)) is None:
                    mine = held[k] = ({}, array("q"))
                strings, places = mine
                text = raw[s:e]
                if (n := strings.get(text)) is None:
                    n = strings[text] = len(strings)
                    size += e - s
                places.extend((n, i, h, f))
                size += 32
            if size > FLUSH_BYTES:
                yield from _blobs(held)
                held, size = {}, 0
        yield from _blobs(held)

    return run


def _blobs(held) -> Iterator[pa.RecordBatch]:
    keys = list(held)
    for at in range(0, len(keys), 256):
        some = keys[at : at + 256]
        yield as_batch({
            "bucket": some,
            "strings": [squeeze(b"\n".join(held[k][0])) for k in some],
            "places": [squeeze(np.frombuffer(held[k][1], dtype=np.int64).reshape(-1, 4).T.tobytes()) for k in some],
        }, BLOBS)


def _repeated(buffer: WordBuffer, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which windows stand in the bucket more than once: sorted by hash, compared by content."""
    order = np.argsort(hashes := buffer.hashes(start, end), kind="stable")
    ranked = hashes[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.append(head, len(order)))
    twice = np.zeros(len(order), dtype=bool)
    alone = size == 1
    twice[order[head[alone]]] = weight[order[head[alone]]] > 1
    raw = buffer.raw
    for h, n in zip(head[~alone].tolist(), size[~alone].tolist()):
        members = order[h : h + n]
        spans = list(zip(start[members].tolist(), end[members].tolist()))
        model = raw[spans[0][0] : spans[0][1]]
        if all(raw[s:e] == model for s, e in spans):
            twice[members] = True
        else:
            tally: dict[bytes, int] = {}
            for (s, e), m in zip(spans, members):
                tally[raw[s:e]] = tally.get(raw[s:e], 0) + int(weight[m])
            twice[members] = [tally[raw[s:e]] > 1 for s, e in spans]
    return twice


def _find(batches):
    """Ranges of words covered by repeated windows, bucket by bucket."""
    for _, rows in by_key(batches, "bucket"):
        strings: dict[bytes, int] = {}
        parts = []
        for row in rows:
            local = np.array([strings.setdefault(s, len(strings)) for s in unsqueeze(row["strings"]).split(b"\n")])
            places = np.frombuffer(unsqueeze(row["places"]), dtype=np.int64).reshape(4, -1)
            parts.append(np.concatenate([[local[places[0]]], places[1:]]))
        run, doc, text_hash, first = np.concatenate(parts, axis=1)
        order = np.argsort(run, kind="stable")
        run, doc, text_hash, first = run[order], doc[order], text_hash[order], first[order]
        times = np.bincount(run, minlength=len(strings))
        buffer = WordBuffer(list(strings))
        piece = buffer.piece
        window = np.flatnonzero(piece[: len(piece) - WINDOW + 1] == piece[WINDOW - 1 :])
        of = piece[window]
        twice = _repeated(buffer, buffer.start[window], buffer.end[window + WINDOW - 1], times[of])
        joined = np.zeros(len(window), dtype=bool)
        joined[1:] = twice[:-1] & (of[1:] == of[:-1])
        a = np.flatnonzero(twice & ~joined)
        ends = np.ones(len(window), dtype=bool)
        ends[:-1] = ~(twice[1:] & joined[1:])
        b = np.flatnonzero(twice & ends)
        if not len(a):
            continue
        opens = np.searchsorted(piece, np.arange(len(strings)))
        lo, hi, of = window[a] - opens[of[a]], window[b] - opens[of[b]] + WINDOW, of[a]
        opens = np.searchsorted(run, np.arange(len(strings)))
        where = ragged(opens[of], times[of])
        lo, hi = np.repeat(lo, times[of]) + first[where], np.repeat(hi, times[of]) + first[where]
        for k in range(0, len(where), 50_000):
            part = slice(k, k + 50_000)
            yield as_batch({"doc_id": doc[where[part]], "text_hash": text_hash[where[part]], "lo": lo[part], "hi": hi[part]}, RANGES)


def _cut(batches):
    """Each text without the words of its ranges."""
    for chunk in chunks(batches, 2 << 20):
        columns: dict[str, list] = {f.name: [] for f in RESULT}
        for i, text, ranges in zip(*(chunk.column(c).to_pylist() for c in ("doc_id", "text", "ranges"))):
            words = text.encode().split()
            n = len(words)
            if ranges:
                kept, at = [], 0
                for r in sorted((r["lo"], r["hi"]) for r in ranges):
                    kept += words[at : r[0]]
                    at = max(at, r[1])
                words = kept + words[at:]
            kept = b" ".join(words)
            columns["doc_id"].append(i)
            columns["n_words"].append(n)
            columns["n_removed"].append(n - len(words))
            columns["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            columns["kept_text"].append(kept.decode())
        yield as_batch(columns, RESULT)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, lo, hi): word ranges covered by windows that stand elsewhere too.

    ``docs`` is what :func:`keyed_text` returns.  Ranges of one text may overlap.
    """
    spark = docs.sparkSession
    n_bytes = text_bytes(docs)
    slots = docs.mapInArrow(_count_slots, "slot int, windows long").groupBy("slot").agg(F.sum("windows").alias("windows"))
    counted = np.zeros(SLOTS, dtype=np.int64)
    for row in slots.collect():  # at most SLOTS rows
        counted[row.slot] = row.windows
    buckets = max(math.ceil(n_bytes * SPREAD / BUCKET_BYTES), 8)
    hot = counted > max(counted.sum() / (4 * buckets), 8 * counted.mean(), 1000)
    return (
        docs.mapInArrow(_pack(hot, buckets), "bucket long, strings binary, places binary")
        .repartition(parts_for(spark, n_bytes), "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_find, "doc_id long, text_hash long, lo long, hi long")
    )


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with the words that repeated windows cover taken out."""
    docs = keyed_text(docs, id_col, text_col)
    ranges = repeated_ranges(docs).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    ranges = ranges.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_text"), "ranges")
    same = (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("of")) & (F.col("text_hash") == F.col("of_text"))
    joined = docs.join(ranges, same, "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(documents(spark, sf_dir)).drop("kept_text")


#: Lists of words are cut where the separators stand; a window is one string of 35 of them.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w
  FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS t FROM documents)),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
dup AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM win JOIN dup USING (h), range(0, 35) AS r(k) GROUP BY doc_id),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
gone AS (SELECT doc_id, unnest(gone) AS i FROM hit),
kept AS (
  SELECT p.doc_id, string_agg(p.w[p.i], ' ' ORDER BY p.i) AS t, count(*) AS n
  FROM pos p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
