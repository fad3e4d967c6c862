"""BPE against its library, exact round trips, and packing invariants."""

import hashlib
import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from bizlake.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def _texts():
    rng = random.Random(2)
    letters = [" ", "  ", "\n", "\t", "a", "th", "ing", "1", "'s", "é", "日", "😀", "!", "\x1c", "<|endoftext|>"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "a" * 5000]


def test_ids_and_round_trip(frame):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    texts = _texts()
    rows = bpe.encode_documents(frame(texts), RANKS, PATTERN).orderBy("doc_id").collect()
    assert [list(r.ids) for r in rows] == [library.encode_ordinary(t or "") for t in texts]
    assert [r.decoded_sha256 for r in rows] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    assert all(bpe.decode_ids(r.ids, RANKS).decode() == (t or "") for r, t in zip(rows[:50], texts))


def test_words_with_marks_are_not_searched_and_outlive_full_tables(monkeypatch):
    monkeypatch.setattr(bpe, "CUTS_KEPT", 8)
    searched, encoded = [], []

    def encode(pieces):
        encoded.extend(pieces)
        return [p.encode() for p in pieces]

    cutter = bpe.Cutter(PATTERN, encode)
    matches = cutter._matches
    cutter._matches = lambda text: searched.append(text) or matches(text)
    texts = [f"One the the, é. and a.b {k}x{k} ! w{k}, the. 1." for k in range(30)]
    assert [cutter([t])[0] for t in texts] == [t.encode() for t in texts]
    assert not {" the", " the,", " the.", " é.", " and"} & set(searched)
    # met in every text, so they are worked out once, though the tables are full many times
    assert encoded.count(" the") == 1 and searched.count(" a.b") == 1


class Rows:
    """Takes the task of a plan, to run it here."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_the_pipeline_leaves_no_tables_in_its_workers(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(packing, "pack", lambda docs, *args, **options: asked.update(options))
    packing.pack_all(spark, None, "")
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    cutter = packing._cutter(VOCABULARY, PATTERN)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a word, x1 y.", "other word"]})
    kept = [b.to_pylist() for b in packing.cut_documents(Rows(), VOCABULARY, PATTERN)([batch])]
    assert cutter._cuts and cutter._pieces
    assert kept == [b.to_pylist() for b in packing.cut_documents(Rows(), VOCABULARY, PATTERN, **asked)([batch])]
    assert not (cutter._cuts or cutter._older or cutter._pieces)


def test_encode_odd(odd):
    assert bpe.encode_documents(odd, RANKS, PATTERN).count() == odd.count()
    assert bpe.encode_documents(odd.limit(0), RANKS, PATTERN).count() == 0


def test_packing(frame):
    rng = random.Random(4)
    texts = [*_texts()[:60], *(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1500))) for _ in range(30))]
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    rows = packing.pack(frame(texts), VOCABULARY, PATTERN).toPandas()
    total = 0
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [packing.CLOSING]
        total += len(ids)
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 1024).all() and own.length.max() <= 1024
        for start, n, crc in zip(own.start, own.length, own.ids_crc32):
            assert zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()) == crc
    rows = rows.sort_values(["sequence_id", "offset"])
    ends = rows.groupby("sequence_id").length.cumsum()
    assert (ends - rows.length == rows.offset).all() and ends.max() <= 1024
    assert rows.sequence_id.nunique() <= total / 1024 * 1.15 + 2


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 3000):
        lengths, counts = np.unique(rng.integers(1, 1025, n), return_counts=True)
        plan = packing.Plan(dict(zip(lengths.tolist(), counts.tolist())))
        fill = np.zeros(plan.sequences, dtype=int)
        placed = {}
        for length, a, b, first, _ in plan.rows:
            fill[first : first + b - a] += length
            placed[length] = placed.get(length, 0) + b - a
        assert placed == dict(zip(lengths.tolist(), counts.tolist())) and (fill <= 1024).all()
        assert plan.sequences <= lengths @ counts / 1024 * 1.03 + 3 if n else plan.sequences == 0


def test_packing_odd(odd):
    assert packing.pack(odd, VOCABULARY, PATTERN).filter("piece = 0").count() == odd.count()
    assert packing.pack(odd.limit(0), VOCABULARY, PATTERN).count() == 0
