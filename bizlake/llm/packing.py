"""Best-fit packing by linear grouping.

Documents become pieces of at most ``CAPACITY`` tokens.  Planning needs only the
number of pieces of each length, so the driver plans over at most ``CAPACITY``
counts: large lengths are dealt to groups of equal cardinality and rounded up to
the longest of their group; configurations of these few sizes are chosen, the
fullest first; actual pieces take the places, which frees what rounding had
added; small pieces then go where they fit best.  The plan is a list of
intervals (length, ranks) to (sequences, place), and every piece finds its
interval by its rank among the pieces of its length.

Defined cases: null and empty texts are the closing id alone; repeated rows are
packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle
from .bpe import Cutter
from .common import as_batch, chunks, documents

CAPACITY = 1024
#: Id after every document.
CLOSING = 2
#: Lengths up to this are small; groups of equal cardinality among the others.
SMALL, GROUPS = 200, 400

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("part", pa.int64()), ("nth", pa.int64()),
])


@lru_cache(maxsize=2)
def _cutter(path: str, pattern: str) -> Cutter:
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path).model
    # the letters that byte-level vocabularies write bytes with: printable ones as they are, others from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}

    def encode(pieces: list[str]) -> list[bytes]:
        ids, ends = array("I"), [0]
        for piece in pieces:
            # of printable ASCII only the blank is written otherwise
            plain = piece.isascii() and piece.isprintable()
            shown = piece.replace(" ", letters[32]) if plain else piece.encode().decode("latin1").translate(letters)
            ids.extend([t.id for t in model.tokenize(shown)])
            ends.append(4 * len(ids))
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    return Cutter(pattern, encode)


def cut_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_tables: bool = True
) -> DataFrame:
    """Pieces of every document, with a number among the task's pieces of that length.

    Workers keep the cutter's tables for their next task, unless ``keep_tables`` is false.
    """

    def run(batches):
        cutter = _cutter(path, pattern)
        part = TaskContext.get().partitionId()
        met = np.zeros(CAPACITY + 1, dtype=np.int64)
        for chunk in chunks(batches):
            columns: dict[str, list] = {f.name: [] for f in PIECES}
            for i, raw in zip(chunk.column("doc_id").to_pylist(), cutter(chunk.column("text").to_pylist())):
                raw += CLOSING.to_bytes(4, "little")
                n = len(raw) // 4
                first = (n - 1) % CAPACITY + 1
                edges = [0, *range(first, n + 1, CAPACITY)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    columns["doc_id"].append(i)
                    columns["piece"].append(k)
                    columns["start"].append(a)
                    columns["length"].append(b - a)
                    columns["ids_crc32"].append(zlib.crc32(raw[4 * a : 4 * b]))
                    columns["part"].append(part)
                    columns["nth"].append(int(met[b - a]))
                    met[b - a] += 1
            yield as_batch(columns, PIECES)
        if not keep_tables:
            cutter.forget()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long")


class Plan:
    """Intervals of ranks of each length and the sequences and places they go to."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS):
        self.capacity = capacity
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, end rank, first sequence, place
        self.sequences = 0
        self._place = 0
        counts = {k: n for k, n in counts.items() if n > 0}
        if n := counts.pop(capacity, 0):
            self.rows.append((capacity, 0, n, 0, 0))
            self.sequences = n
        room: dict[int, list[tuple[int, int]]] = {}
        self._large(sorted(((k, n) for k, n in counts.items() if k > small), reverse=True), groups, room)
        self._small(sorted(((k, n) for k, n in counts.items() if k <= small), reverse=True), room)

    def _large(self, lengths, groups: int, room) -> None:
        total = sum(n for _, n in lengths)
        if not total:
            return
        edges = sorted({total * g // groups for g in range(groups + 1)})
        starts = np.concatenate([[0], np.cumsum([n for _, n in lengths])])
        values = [k for k, _ in lengths]
        rounded, left, at = [], [], list(edges[:-1])
        for a, b in zip(edges, edges[1:]):
            rounded.append(values[int(np.searchsorted(starts, a, side="right")) - 1])
            left.append(b - a)
        while any(left):
            pattern = self._fullest(rounded, left)
            times = min(left[g] // n for g, n in pattern.items())
            begin = self.sequences
            self.sequences += times
            changes = {begin: 0, begin + times: 0}
            used: list[tuple[int, int, int]] = []
            for g, n in pattern.items():
                for _ in range(n):
                    a, done = at[g], 0
                    while done < times:  # actual lengths of the group's next pieces
                        k = int(np.searchsorted(starts, a + done, side="right")) - 1
                        m = min(times - done, int(starts[k + 1]) - a - done)
                        first = a + done - int(starts[k])
                        self.rows.append((values[k], first, first + m, begin + done, self._place))
                        used.append((begin + done, begin + done + m, values[k]))
                        changes[begin + done] = changes[begin + done + m] = 0
                        done += m
                    at[g] += times
                    self._place += 1
                left[g] -= n * times
            edge = sorted(changes)
            taken = np.zeros(len(edge), dtype=np.int64)
            for a, b, length in used:
                taken[edge.index(a) : edge.index(b)] += length
            for a, b, t in zip(edge, edge[1:], taken.tolist()):
                room.setdefault(self.capacity - t, []).append((a, b))

    def _fullest(self, sizes: list[int], left: list[int]) -> dict[int, int]:
        """A configuration with the largest size left, as full as a sequence can be."""
        top = next(g for g, n in enumerate(left) if n)
        space = self.capacity - sizes[top]
        by = np.full(space + 1, -1, dtype=np.int64)  # group that reached this sum last
        reached = np.zeros(space + 1, dtype=bool)
        reached[0] = True
        for g in range(top, len(sizes)):
            size = sizes[g]
            for _ in range(min(left[g] - (g == top), space // size)):
                new = np.zeros(space + 1, dtype=bool)
                new[size:] = reached[:-size]
                new &= ~reached
                if not new.any():
                    break
                by[new] = g
                reached |= new
            if reached[space]:
                break
        pattern = {top: 1}
        total = int(np.flatnonzero(reached)[-1])
        while total:
            g = int(by[total])
            pattern[g] = pattern.get(g, 0) + 1
            total -= sizes[g]
        return pattern

    def _small(self, lengths, room) -> None:
        for length, n in lengths:
            rank = 0
            while rank < n:
                fit = min((r for r, spans in room.items() if r >= length and spans), default=None)
                if fit is None:
                    fresh = -(-(n - rank) // (self.capacity // length))
                    room.setdefault(self.capacity, []).append((self.sequences, self.sequences + fresh))
                    self.sequences += fresh
                    continue
                a, b = room[fit].pop()
                m = min(b - a, n - rank)
                self.rows.append((length, rank, rank + m, a, self._place))
                self._place += 1
                rank += m
                if a + m < b:
                    room[fit].append((a + m, b))
                room.setdefault(fit - length, []).append((a, a + m))


def pack(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_tables: bool = True
) -> DataFrame:
    """Pieces with the sequence and the offset they get."""
    pieces = settle(cut_documents(docs, path, pattern, id_col, text_col, keep_tables), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most CAPACITY rows
    rows = np.array(sorted(Plan(counts).rows), dtype=np.int64).reshape(-1, 5)
    span = np.int64(1 << 40)
    keys = rows[:, 0] * span + rows[:, 1]

    @F.pandas_udf("sequence_id long, place long")
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(keys, length.to_numpy() * span + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": rows[k, 3] + rank.to_numpy() - rows[k, 1], "place": rows[k, 4]})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    seated = pieces.join(first, ["part", "length"]).withColumn("seat", seat("length", F.col("first") + F.col("nth")))
    earlier = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return seated.select("doc_id", "piece", "start", "length", "ids_crc32", "seat.*").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"),
    )


def _public(docs: DataFrame, keep_tables: bool = True) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep_tables=keep_tables)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(documents(spark, sf_dir))


def pack_all(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sequences of what is left.

    The session's workers go on to other stages, so they leave the tables of this one.
    """
    return _public(docs, keep_tables=False)
