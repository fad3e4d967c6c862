"""Byte-level BPE by public ranks, merged with a segment tree.

A segment tree over byte positions holds, for every live part, the rank of the
pair it forms with its right neighbour; the key is (rank, position), so the
root is the leftmost of the least ranks.  A merge changes three leaves: the part
that grew, the one that vanished, and the left neighbour.

Text is cut at single blanks between other characters, where the pattern can't
match across; each cut piece is matched once and its ids are kept in a bounded
table of the worker.

Defined cases: null is empty; empty texts have no tokens; special-token strings
are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, chunks, documents

#: Entries that a worker's tables hold before they start anew.
PIECES_KEPT, CUTS_KEPT = 300_000, 350_000

RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
    ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())),
])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one matched piece."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    never = 1 << 62
    tree = [never] * (2 * size)
    for i in range(n - 1):
        if (rank := ranks.get(piece[i : i + 2])) is not None:
            tree[size + i] = rank * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, key: int) -> None:
        k = size + i
        tree[k] = key
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    after = list(range(1, n + 2))  # start of the next live part
    before = list(range(-1, n))
    while (top := tree[1]) != never:
        i = top % size
        gone = after[i]
        end = after[i] = after[gone]
        before[end] = i
        put(gone, never)
        rank = ranks.get(piece[i : after[end]]) if end < n else None
        put(i, never if rank is None else rank * size + i)
        if (left := before[i]) >= 0:
            rank = ranks.get(piece[left:end])
            put(left, never if rank is None else rank * size + left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Forest:
    """The same merges for many short pieces at once: one row of trees per piece."""

    NEVER = np.int32(1 << 30)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, whole = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(rank)
        self.base = np.uint64(max(ranks.values()) + 1)
        keys = np.array(left, dtype=np.uint64) * self.base + np.array(right, dtype=np.uint64)
        order = np.argsort(self._slot(keys, 1 << 20), kind="stable")
        # open addressing in slot order: each key stands at its slot or after it
        slots = self._slot(keys[order], 1 << 20).astype(np.int64)
        places = np.maximum.accumulate(slots - np.arange(len(slots))) + np.arange(len(slots))
        self.reach = int((places - slots).max()) + 1 if len(slots) else 1
        self.keys = np.full((1 << 20) + len(slots) + self.reach, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.values = np.full(len(self.keys), self.NEVER, dtype=np.int32)
        self.keys[places] = keys[order]
        self.values[places] = np.array(whole, dtype=np.int32)[order]

    @staticmethod
    def _slot(keys: np.ndarray, n: int) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (n.bit_length() - 1))

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NEVER."""
        keys = a.astype(np.uint64) * self.base + b.astype(np.uint64)
        at = self._slot(keys, 1 << 20).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.values[at], self.NEVER)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.values[at] != self.NEVER))
        for step in range(1, self.reach):
            if not len(open_):
                break
            place = at[open_] + step
            hit = self.keys[place] == keys[open_]
            out[open_[hit]] = self.values[place[hit]]
            open_ = open_[~hit & (self.values[place] != self.NEVER)]
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(piece) > 64:
                out[k] = np.array(merge(piece, self.ranks), dtype="<u4").tobytes()
            else:
                groups.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(k)
        for size, members in groups.items():
            for at in range(0, len(members), 20_000):
                some = members[at : at + 20_000]
                for k, ids in zip(some, self._merge([pieces[k] for k in some], size)):
                    out[k] = ids
        return out

    def _merge(self, pieces: list[bytes], size: int) -> list[bytes]:
        n = np.array([len(p) for p in pieces])
        count = len(pieces)
        data = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8)
        ids = np.concatenate([self.single[data].reshape(count, size), np.zeros((count, 1), np.int32)], axis=1)
        place = np.arange(size, dtype=np.int32)
        never = self.NEVER
        tree = np.full((count, 2 * size), never, dtype=np.int32)
        pairs = self.pair(ids[:, : size - 1].ravel(), ids[:, 1:size].ravel()).reshape(count, size - 1)
        tree[:, size : 2 * size - 1] = np.where((place[:-1] < n[:, None] - 1) & (pairs != never), pairs * size + place[:-1], never)
        level = size
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
            level //= 2
        after = np.tile(np.arange(1, size + 2, dtype=np.int64), (count, 1))
        before = np.tile(np.arange(-1, size, dtype=np.int64), (count, 1))
        live = np.tile(place, (count, 1)) < n[:, None]
        flat_ids, flat_tree, flat_after, flat_before = ids.ravel(), tree.ravel(), after.ravel(), before.ravel()
        wide, rows = size + 1, np.arange(count)
        while len(rows := rows[tree[rows, 1] != never]):
            top = tree[rows, 1].astype(np.int64)
            i, base, trunk, length = top % size, rows * wide, rows * 2 * size, n[rows]
            gone = flat_after[base + i]
            end = flat_after[base + gone]
            flat_after[base + i] = end
            flat_before[base + end] = i
            flat_ids[base + i] = top // size
            live[rows, gone] = False
            here = self.pair(flat_ids[base + i], flat_ids[base + end])
            here = np.where((end < length) & (here != never), here * size + i, never)
            left = flat_before[base + i]
            has = left >= 0
            left = np.where(has, left, i)
            there = self.pair(flat_ids[base + left], flat_ids[base + i])
            there = np.where(has, np.where(there != never, there * size + left, never), here)
            flat_tree[trunk + size + gone] = never
            flat_tree[trunk + size + i] = here
            flat_tree[trunk + size + left] = there
            a, b, c = (size + gone) >> 1, (size + i) >> 1, (size + left) >> 1
            while a[0]:
                for k in (a, b, c):
                    flat_tree[trunk + k] = np.minimum(flat_tree[trunk + 2 * k], flat_tree[trunk + 2 * k + 1])
                a, b, c = a >> 1, b >> 1, c >> 1
        raw = ids[:, :size][live].astype("<u4").tobytes()
        ends = (np.cumsum(live.sum(axis=1)) * 4).tolist()
        return [raw[s:e] for s, e in zip([0, *ends], ends)]


class Cutter:
    """Ids of texts as little-endian 32-bit numbers, with tables of pieces met before.

    ``encode`` gives the ids of many matches of ``pattern`` at once.
    """

    #: White space but the blank.
    WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
    #: Marks that are a match of their own after letters, at the end of a cut.
    MARKS = frozenset(".,;:!?")
    APART = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]]):
        self._matches = regex.compile(pattern).findall
        self._encode = encode
        self._pieces: dict[str, bytes] = {}
        self._cuts: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empty the tables; the worker that holds them goes on to other work."""
        self._pieces, self._cuts, self._older = {}, {}, {}

    @classmethod
    def close(cls, text: str) -> bool:
        """Whether a blank is next to white space; such texts are cut with more care."""
        # printable text has no white space but blanks
        return "  " in text or not text.isprintable() and any(c in text and (f" {c}" in text or f"{c} " in text) for c in cls.WHITE)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self._cuts) >= CUTS_KEPT // 2:
            self._older, self._cuts = self._cuts, {}
        if len(self._pieces) >= PIECES_KEPT:
            self._pieces.clear()
        cuts, older, pieces = self._cuts, self._older, self._pieces
        parts = [self.APART.split(t) if self.close(t) else t.split(" ") for t in texts]
        # no blank precedes the first cut of a text
        heads = [self._matches(p.pop(0)) for p in parts]
        new = set().union(*parts).difference(cuts)
        # what is still met moves on to the newer table
        met = new.intersection(older)
        cuts.update(zip(met, map(older.__getitem__, met)))
        new -= met
        # letters alone are one match, a mark after them is another
        plain = set(filter(str.isalpha, new))
        new -= plain
        ended = [c for c in new if c[-1:] in self.MARKS and c[:-1].isalpha()]
        new.difference_update(ended)
        plain.update({c[:-1] for c in ended}.difference(cuts))
        matched = {c: self._matches(" " + c) for c in new}
        fresh = {m for group in (matched.values(), heads) for ms in group for m in ms}.union(c[-1] for c in ended).difference(pieces)
        pieces.update(zip(fresh, self._encode(list(fresh))))
        cuts.update(zip(plain, self._encode([" " + c for c in plain])))
        for c in ended:
            cuts[c] = cuts[c[:-1]] + pieces[c[-1]]
        for c, ms in matched.items():
            cuts[c] = b"".join([pieces[m] for m in ms])
        return [b"".join([pieces[m] for m in head]) + b"".join(map(cuts.__getitem__, p)) for head, p in zip(heads, parts)]


@lru_cache(maxsize=2)
def _byte_bpe(path: str, pattern: str):
    ranks = load_ranks(path)
    vocabulary = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        vocabulary[rank] = token
    forest = Forest(ranks)
    cutter = Cutter(pattern, lambda pieces: forest.merge([p.encode() for p in pieces]))
    return cutter, vocabulary, [str(i) for i in range(len(vocabulary))]


def no_vocabulary() -> None:
    """Free what a worker holds for cutting; its next tasks do other work."""
    _byte_bpe.cache_clear()
    load_ranks.cache_clear()


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Ids of every whole text and digests of the ids and of the decoded bytes."""

    def run(batches):
        cutter, vocabulary, names = _byte_bpe(path, pattern)
        for chunk in chunks(batches):
            columns: dict[str, list] = {f.name: [] for f in RESULT}
            for i, raw in zip(chunk.column("doc_id").to_pylist(), cutter(chunk.column("text").to_pylist())):
                ids = memoryview(raw).cast("I").tolist()
                columns["doc_id"].append(i)
                columns["n_tokens"].append(len(ids))
                columns["ids_sha256"].append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                columns["decoded_sha256"].append(hashlib.sha256(b"".join(map(vocabulary.__getitem__, ids))).hexdigest())
                columns["ids"].append(ids if with_ids else None)
            yield as_batch(columns, RESULT)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")


def decode_ids(ids: list[int], path: str) -> bytes:
    """Bytes of a list of ids."""
    by_rank = {rank: token for token, rank in load_ranks(path).items()}
    return b"".join(by_rank[i] for i in ids)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN, with_ids=False).drop("ids")
