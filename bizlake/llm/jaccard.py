"""N-gram Jaccard join by parity sketches.

A document's set is its distinct shingles of ``SHINGLE`` words, as 64-bit hashes.
The parity sketch of a set flips one bit per shingle, so the Hamming distance of
two sketches is at most the symmetric difference of the sets; sets that link
differ in at most a ninth of the sum of their sizes.

Candidates: sets are dealt to bands by size, and in each band the (wide, sparse)
sketch is cut into about twice as many slices as a linking pair can differ
in.  A slice is known by the XOR of its shingles' hashes.  All slices stand in one
order, the same for every set: by the count of their rarest shingle in the whole
corpus (from a table of ``SLOTS`` counters that hashes share), empty ones last,
then by their place.
If a pair can differ in d slices, the first equal one has at most d before it in
either set, so each set is looked up by its first d + 1 and the slices of common
passages are left out.

Equal sets are one vertex, known by the XOR of its hashes.  Of its groups with
an equal slice, every vertex is first compared with one other.  Then, in rounds,
every vertex of a group that still holds several components is compared with the
nearest sketch of another component among about ``NEAREST`` members of its group,
until rounds find little.  At last all pairs of a group in different components
are compared, in cells of ``CELL`` members, so no link between components is
lost, and large groups of near copies, one component by then, give no pairs.
Sketches are compared inside the task that holds the cell: a pair becomes a row
only if its short parity sketches let it link.  It is verified on whole sets.

Defined cases: null and empty texts have no shingles and no links; fewer than
``SHINGLE`` words make one shingle; repeated rows share a vertex; a null id is
never the smallest of its component unless nothing else is in it.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..session import settle
from .common import (
    NO_ID, WordBuffer, as_batch, by_key, chunks, documents, keyed_text, mix, parts_for, ragged, squeeze,
    text_bytes, unsqueeze,
)
from .components import components

SHINGLE = 5
#: Similarity of 80 parts in a hundred: sets link if 9 * difference <= size + size.
NINTHS = 9
#: Bits of the short sketch that is compared before texts are moved.
SKETCH_BITS = 2048
#: Texts that are compared with one other in a task.
GROUP = 200
#: Members of a group that a round looks for near ones in, and members of a cell of the last pass.
NEAREST, CELL = 256, 4096
#: Rounds end when links found are fewer than one in so many vertices of open groups.
FEW = 20
#: Keys that a task holds before it hands its blobs on, and keys in a bucket.
FLUSH_KEYS, BUCKET_KEYS = 800_000, 400_000
#: Slice keys for a byte of text.
KEYS_PER_BYTE = 0.09
#: Counters of shingles for the order of slices, and counters in a row of them.
SLOTS, SLOT_ROW = 1 << 20, 1 << 14

SETS = pa.schema([
    ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("vertex", pa.int64()), ("sketch", pa.binary()),
    ("slot", pa.int32()),
])
COUNTS = pa.schema([("slot", pa.int32()), ("sketch", pa.binary())])
BLOBS = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("vertices", pa.binary())])
FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, and the text each belongs to, in order."""
    words = [t.encode().lower().split() for t in texts]
    full = [k for k, w in enumerate(words) if w]
    if not full:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    buffer = WordBuffer([b" ".join(words[k]) for k in full])
    n = np.array([len(words[k]) for k in full])
    opens = np.cumsum(n) - n
    many = np.maximum(n - SHINGLE + 1, 1)
    first = ragged(opens, many)
    owner = np.repeat(np.arange(len(full)), many)
    last = np.minimum(first + SHINGLE - 1, (opens + n - 1)[owner])
    hashes = buffer.hashes(buffer.start[first], buffer.end[last])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.array(full)[owner[new]]


def vertices_of(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A number for each set that equal sets share."""
    out = np.zeros(n, dtype=np.uint64)
    np.bitwise_xor.at(out, owner, mix(hashes ^ np.uint64(0xA5A5A5A5DEADBEEF)))
    return mix(out + np.bincount(owner, minlength=n).astype(np.uint64)).view(np.int64)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0xC0047)) % np.uint64(SLOTS)).astype(np.int64)


def _counters(counts: np.ndarray) -> dict[str, list]:
    """Rows of counters that are not all zero."""
    rows = [k for k, row in enumerate(counts.reshape(-1, SLOT_ROW)) if row.any()]
    return {"slot": rows, "sketch": [squeeze(counts[k * SLOT_ROW : (k + 1) * SLOT_ROW].tobytes()) for k in rows]}


def _described(batches):
    """One row per text, then the counters of the shingles of its task's distinct sets."""
    counts = np.zeros(SLOTS, dtype=np.int64)
    seen: set[int] = set()
    for chunk in chunks(batches):
        n = chunk.num_rows
        hashes, owner = shingle_sets(chunk.column("text").to_pylist())
        sizes = np.bincount(owner, minlength=n)
        packed = np.zeros(n * SKETCH_BITS // 8, dtype=np.uint8)
        bit = (mix(hashes) % np.uint64(SKETCH_BITS)).astype(np.int64)
        np.bitwise_xor.at(packed, owner * (SKETCH_BITS // 8) + bit // 8, (1 << bit % 8).astype(np.uint8))
        packed = packed.reshape(n, SKETCH_BITS // 8)
        vertex = vertices_of(hashes, owner, n)
        yield as_batch({
            "doc_id": chunk.column("doc_id"), "text_hash": chunk.column("text_hash"), "n_shingles": sizes,
            "vertex": pa.array(vertex, mask=sizes == 0), "sketch": [row.tobytes() if s else None for row, s in zip(packed, sizes)],
            "slot": [None] * n,
        }, SETS)
        new = np.array([v not in seen and not seen.add(v) for v in vertex.tolist()], dtype=bool)
        counts += np.bincount(_slot(hashes[new[owner]]), minlength=SLOTS)
    rows = _counters(counts)
    none = [None] * len(rows["slot"])
    yield as_batch({"doc_id": none, "text_hash": none, "n_shingles": none, "vertex": none, **rows}, SETS)


def _added(batches):
    """Rows of counters summed over the partition."""
    counts = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        for k, raw in zip(batch.column("slot").to_pylist(), batch.column("sketch")):
            counts[k * SLOT_ROW : (k + 1) * SLOT_ROW] += np.frombuffer(unsqueeze(raw.as_py()), dtype=np.int64)
    yield as_batch(_counters(counts), COUNTS)


def corpus_ranks(counters: DataFrame) -> np.ndarray:
    """For every slot the count of its shingles as a byte, in steps of a quarter of a power of two, at most 254.

    The driver holds ``SLOTS`` numbers, whatever the size of the corpus.
    """
    parts = SLOTS // SLOT_ROW
    added = counters.mapInArrow(_added, "slot int, sketch binary").repartition(parts, "slot").mapInArrow(_added, "slot int, sketch binary")
    counts = np.zeros(SLOTS, dtype=np.int64)
    for row in added.collect():
        counts[row.slot * SLOT_ROW : (row.slot + 1) * SLOT_ROW] = np.frombuffer(unsqueeze(bytes(row.sketch)), dtype=np.int64)
    return np.minimum(4 * np.log2(counts + 1.0), 254).astype(np.uint8)


@lru_cache(maxsize=1)
def _edges(limit: int = 1 << 40) -> np.ndarray:
    """First size of each band: a set and anything up to 5/4 of it lie in one or two bands."""
    edges = [1]
    while edges[-1] < limit:
        edges.append(edges[-1] * 5 // 4 + 1)
    return np.array(edges, dtype=np.int64)


def most_apart(band: np.ndarray) -> np.ndarray:
    """In how many shingles the linking pairs of a band can differ at most."""
    return 2 * (_edges()[band + 1] - 1) // NINTHS


def slices(band: np.ndarray) -> np.ndarray:
    """Slices of each band."""
    return 2 * most_apart(band) + 8


def _slice_keys(hashes: np.ndarray, owner: np.ndarray, n: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) for the slices that each set is looked up by."""
    sizes = np.bincount(owner, minlength=n)
    edges = _edges()
    band = np.searchsorted(edges, np.maximum(sizes, 1), side="right") - 1
    rank_of = ranks[_slot(hashes)]
    keys, texts = [], []
    for up in (0, 1):
        # partners in this band: own sizes, or the larger ones that reach the next band
        largest = np.minimum(sizes * 5 // 4, edges[band + 1 + up] - 1)
        mine = (sizes > 0) & (largest >= edges[band + up])
        if not mine.any():
            continue
        total = np.where(mine, slices(band + up), 0)
        used = np.where(mine, (sizes + largest) // NINTHS + 1, 0)
        opens = np.cumsum(total) - total
        take = mine[owner]
        h, o = hashes[take], owner[take]
        at = opens[o] + (mix(h ^ np.uint64(0x51CE)) % total[o].astype(np.uint64)).astype(np.int64)
        word = np.zeros(int(total.sum()), dtype=np.uint64)
        np.bitwise_xor.at(word, at, mix(h))
        # a slice is shared only by texts that share all of its shingles
        rank = np.full(len(word), 255, dtype=np.uint8)
        np.minimum.at(rank, at, rank_of[take])
        text = np.repeat(np.arange(n), total)
        number = np.arange(len(word)) - opens[text]
        # by rank, then number: one order of whatever slices two sets share
        order = np.argsort((text << 40) + (rank.astype(np.int64) << 32) + number)
        kept = order[ragged(opens, used)]
        label = number[kept].astype(np.uint64) * np.uint64(4096) + (band[text[kept]] + up + 1).astype(np.uint64)
        keys.append(mix(word[kept] ^ mix(label)))
        texts.append(text[kept])
    if not keys:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate(keys), np.concatenate(texts)


def _deal(buckets: int, ranks):
    """Task that sends slice keys to their buckets; a set that repeats in the task is sent once."""

    def blobs(key, vertex):
        bucket = (key >> np.uint64(48)) % np.uint64(buckets) if buckets < 1 << 16 else (key >> np.uint64(24)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, key, vertex = bucket[order].astype(np.int64), key[order], vertex[order]
        opens = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for at in range(0, len(opens), 256):
            rows: dict[str, list] = {"bucket": [], "keys": [], "vertices": []}
            for a, b in zip(opens[at : at + 256], np.append(opens, len(bucket))[at + 1 : at + 257]):
                table, index = np.unique(vertex[a:b], return_inverse=True)
                order = np.argsort(index, kind="stable")
                low = key[a:b][order] & np.uint64((1 << 48) - 1)
                rows["bucket"].append(int(bucket[a]))
                rows["keys"].append((low & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (low >> np.uint64(32)).astype(np.uint16).tobytes())
                rows["vertices"].append(squeeze(np.append(len(table), table).astype(np.int64).tobytes() + np.bincount(index).astype(np.int32).tobytes()))
            yield as_batch(rows, BLOBS)

    def run(batches):
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for chunk in chunks(batches, 2 << 20):
            hashes, owner = shingle_sets(chunk.column("text").to_pylist())
            vertex = vertices_of(hashes, owner, chunk.num_rows)
            new = np.array([v not in seen and not seen.add(v) for v in vertex.tolist()], dtype=bool)
            take = new[owner]
            key, text = _slice_keys(hashes[take], owner[take], chunk.num_rows, ranks.value)
            held.append((key, vertex[text]))
            size += len(key)
            if size > FLUSH_KEYS:
                yield from blobs(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield from blobs(*map(np.concatenate, zip(*held)))

    return run


def _meet(batches):
    """Of each group with an equal slice: links to its least vertex (0), and the group if larger than two (1)."""
    for _, rows in by_key(batches, "bucket"):
        keys, vertices = [], []
        for row in rows:
            raw = unsqueeze(row["vertices"])
            n = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
            table = np.frombuffer(raw[8 : 8 + 8 * n], dtype=np.int64)
            vertices.append(np.repeat(table, np.frombuffer(raw[8 + 8 * n :], dtype=np.int32)))
            m = len(vertices[-1])
            low = np.frombuffer(row["keys"][: 4 * m], dtype=np.uint32).astype(np.int64)
            keys.append(low + (np.frombuffer(row["keys"][4 * m :], dtype=np.uint16).astype(np.int64) << 32))
        key, vertex = np.concatenate(keys), np.concatenate(vertices)
        order = np.lexsort((vertex, key))
        key, vertex = key[order], vertex[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (vertex[1:] != vertex[:-1])
        key, vertex = key[new], vertex[new]
        opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(opens, len(key)))
        least = np.repeat(vertex[opens], size)
        other = np.repeat(size, size) > 1
        other[opens] = False
        pairs = pd.DataFrame({"a": least[other], "b": vertex[other]}).drop_duplicates()
        large = np.repeat(size, size) > 2
        mixed = mix(key.view(np.uint64) + np.uint64(rows[0]["bucket"] << 48 & (1 << 64) - 1)).view(np.int64)
        for kind, a, b in ((0, pairs["a"].to_numpy(), pairs["b"].to_numpy()), (1, mixed[large], vertex[large])):
            for at in range(0, len(a), 100_000):
                yield as_batch({"kind": np.full(len(a[at : at + 100_000]), kind), "a": a[at : at + 100_000], "b": b[at : at + 100_000]}, FOUND)


def _verified(batches):
    """Pairs whose sets are similar enough: each group opens with the set that its others are compared with."""
    base = np.empty(0, dtype=np.uint64)
    for chunk in chunks(batches):
        hashes, owner = shingle_sets(chunk.column("text").to_pylist())
        opens = np.searchsorted(owner, np.arange(chunk.num_rows + 1))
        left, right = [], []
        for k, (a, first, vertex) in enumerate(zip(*(chunk.column(c).to_pylist() for c in ("a", "first", "vertex")))):
            own = hashes[opens[k] : opens[k + 1]]
            if first:
                base = own
                continue
            at = np.minimum(np.searchsorted(base, own), len(base) - 1)
            shared = int((base[at] == own).sum())
            if 100 * shared >= 80 * (len(base) + len(own) - shared):
                left.append(a)
                right.append(vertex)
        yield as_batch({"a": left, "b": right}, PAIRS)


@F.pandas_udf(IntegerType())
def _hamming(x: pd.Series, y: pd.Series) -> pd.Series:
    if not len(x):
        return pd.Series([], dtype="int32")
    a, b = (np.frombuffer(b"".join(s), dtype=np.uint64).reshape(len(s), -1) for s in (x, y))
    return pd.Series(np.bitwise_count(a ^ b).sum(axis=1).astype("int32"))


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and short sketches let them link."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("vertex").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
    close = (NINTHS * F.abs(F.col("n_a") - F.col("n_b")) <= F.col("n_a") + F.col("n_b")) & (
        NINTHS * _hamming("s_a", "s_b") <= F.col("n_a") + F.col("n_b")
    )
    return settle(pairs.filter(close).select("a", "b"), "near")


def _cells(batches):
    """(vertex, root, size, side, sketch) of each cell; rows come sorted by ``cell``."""
    held: list[tuple[np.ndarray, ...]] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, *numbers = (batch.column(c).to_numpy() for c in ("cell", "vertex", "root", "n_shingles", "side"))
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(cell), -1)
        opens = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
        for a, b in zip(opens, opens[1:]):
            if held and cell[a] != current:
                yield tuple(map(np.concatenate, zip(*held)))
                held = []
            current = cell[a]
            held.append((*(x[a:b] for x in numbers), sketch[a:b]))
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _compared(nearest: bool):
    """Task that compares the sketches of a cell: all close pairs of different roots, or each vertex's nearest."""

    def run(batches):
        for vertex, root, size, side, sketch in _cells(batches):
            names, index, count = np.unique(root, return_inverse=True, return_counts=True)
            # pairs inside the largest component need no look, so its members open no row
            rows = np.flatnonzero(index != count.argmax())
            step = max((1 << 17) // len(vertex), 1)
            for at in range(0, len(rows), step):
                i = rows[at : at + step, None]
                apart = np.bitwise_count(sketch[i] ^ sketch[None, :, :]).sum(axis=2, dtype=np.int64)
                total = size[i] + size[None, :]
                close = (NINTHS * apart <= total) & (NINTHS * np.abs(size[i] - size[None, :]) <= total)
                close &= (index[i] != index[None, :]) & ((side[i] != side[None, :]) | (side[i] == 2))
                if nearest:
                    best = np.where(close, apart, 1 << 40).argmin(axis=1)
                    x = np.flatnonzero(close[np.arange(len(close)), best])
                    y = best[x]
                else:
                    x, y = np.nonzero(close)
                a, b = vertex[i[x, 0]], vertex[y]
                if len(a):
                    low, high = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                    yield as_batch({"a": low, "b": high}, PAIRS)

    return run


def _compare(rooted: DataFrame, sets: DataFrame, nearest: bool, turn: int = 0) -> DataFrame:
    """Pairs (a, b) of different roots and one key whose sketches let them link.

    ``rooted`` has (key, vertex, root, members).  A key with many members is cut:
    for ``nearest`` into parts drawn anew each turn, else into blocks whose pairs
    are cells, so that every pair meets and no task holds more than two blocks.
    """
    rows = rooted.join(sets.select("vertex", "n_shingles", "sketch"), "vertex")
    if nearest:
        part = F.pmod(F.xxhash64("vertex", F.lit(turn)), F.ceil(F.col("members") / NEAREST))
        rows = rows.withColumn("cell", F.xxhash64("key", part)).withColumn("side", F.lit(2))
    else:
        blocks = F.ceil(F.col("members") / CELL)
        rows = rows.withColumn("block", F.pmod(F.xxhash64("vertex"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        rows = rows.withColumn("cell", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
        rows = rows.withColumn("side", F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") < F.col("other")).cast("int")))
    rows = rows.select("cell", "vertex", "root", F.col("n_shingles").cast("long").alias("n_shingles"), "side", "sketch")
    parts = int(rooted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_compared(nearest), "a long, b long")


def _still_open(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(key, vertex, root, members) of the groups that hold several components."""
    rooted = groups.join(found.withColumnRenamed("node", "vertex"), "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    counted = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
    return settle(rooted.join(counted.filter("low < high").select("key", "members"), "key"), "open")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
        pairs = pairs.withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs.filter("root_a <> root_b").select("a", "b")


def _verify(near: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link.

    The texts compared with a go to groups of at most about ``GROUP`` and their
    tasks read them as a stream, after a's own text; a text moves once for each
    pair, a's once for each group.
    """
    spark = near.sparkSession
    many = near.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    rows = near.join(many, "a").select("a", F.pmod(F.xxhash64("b"), "groups").alias("salt"), F.lit(False).alias("first"), F.col("b").alias("vertex"))
    heads = rows.select("a", "salt").distinct().select("a", "salt", F.lit(True).alias("first"), F.col("a").alias("vertex"))
    dealt = rows.unionByName(heads).join(texts, "vertex")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = dealt.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.desc("first"))
    return settle(stream.select("a", "first", "vertex", "text").mapInArrow(_verified, "a long, b long"), "verified")


def _grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, root, component_id) per document; ``root`` is null without shingles."""
    spark = docs.sparkSession
    docs = keyed_text(docs, id_col, text_col)
    n_bytes = text_bytes(docs)
    columns = "doc_id long, text_hash long, n_shingles long, vertex long, sketch binary, slot int"
    described = settle(docs.mapInArrow(_described, columns), "sets")
    ranks = spark.sparkContext.broadcast(corpus_ranks(described.filter("slot is not null").select("slot", "sketch")))
    described = described.filter("slot is null").drop("slot")
    sets = described.filter("n_shingles > 0").groupBy("vertex").agg(
        F.min_by(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.col("text_hash").alias("t")), F.struct("doc_id", "text_hash")).alias("place"),
        F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"),
    )
    sets = settle(sets.select("vertex", F.col("place.d").alias("of_doc"), F.col("place.t").alias("of_text"), "least_id", "n_shingles", "sketch"), "vertices")
    buckets = max(math.ceil(n_bytes * KEYS_PER_BYTE / BUCKET_KEYS), 16)
    met = settle(
        docs.mapInArrow(_deal(buckets, ranks), "bucket long, keys binary, vertices binary")
        .repartition(parts_for(spark, n_bytes), "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_meet, "kind int, a long, b long"),
        "met",
    )
    near = _near(met.filter("kind = 0").select("a", "b").distinct(), sets)
    wanted = met.filter("kind = 0").select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    places = sets.join(wanted, "vertex").select("vertex", "of_doc", "of_text")
    same = (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("of_doc")) & (F.col("text_hash") == F.col("of_text"))
    texts = settle(docs.join(places, same).groupBy("vertex").agg(F.first("text").alias("text")), "texts")
    # each vertex with one other first: most groups are whole after this
    links = _verify(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts)
    found = settle(components(links), "components")
    # the other pairs of the first comparison, and the nearest ones of other components, in rounds
    groups = met.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("vertex"))
    pairs, turn = _apart(near, found), 0
    while True:
        open_ = _still_open(groups, found)
        groups = open_.select("key", "vertex")
        # written once: which of two equally near ones is found depends on the order of rows
        pairs = settle(pairs.unionByName(_compare(open_, sets, True, turn)).distinct(), "nearest")
        new = _verify(pairs, texts)
        found = settle(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new)), "components")
        if FEW * new.count() <= open_.agg(F.count_distinct("vertex")).first()[0]:
            break
        pairs, turn = pairs.limit(0), turn + 1
    # then every pair with an equal slice whose ends are in different components
    new = _verify(settle(_compare(_still_open(groups, found), sets, False).distinct(), "across"), texts)
    found = settle(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new)), "components")
    ids = sets.select("vertex", "least_id").join(found.withColumnRenamed("node", "vertex"), "vertex")
    least = ids.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = ids.join(least, "root").select("vertex", "root", "component_id")
    alone = sets.join(named.select("vertex"), "vertex", "left_anti").select(
        "vertex", F.col("vertex").alias("root"), F.col("least_id").alias("component_id")
    )
    result = described.select("doc_id", "text_hash", "n_shingles", "vertex").join(named.unionByName(alone), "vertex", "left")
    root = F.when(F.col("n_shingles") > 0, F.col("root")).alias("root")
    return result.select("doc_id", "text_hash", "n_shingles", root, F.coalesce("component_id", "doc_id").alias("component_id"))


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per document.

    ``component_id`` is the smallest id among all documents reachable by links.
    """
    return _grouped(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(documents(spark, sf_dir))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every component the document with the smallest id stays.

    A row without an id stays only if no row of its component has one.  Rows are
    told by id and text; where both repeat, the rows' hashes settle which one
    stays.  Documents without words are linked with nothing and stay, all of them.
    """
    rows = settle(_grouped(docs).select("doc_id", "text_hash", "root"), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "text_hash")).alias("first")
    heads = rows.filter("root is not null").groupBy("root").agg(first).select("root", "first.doc_id", "first.text_hash")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    times = rows.filter("root is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    heads = heads.alias("a").join(times.alias("b"), same).select("a.doc_id", "a.text_hash", "n")
    wordless = rows.filter("root is null").select("doc_id", "text_hash", F.lit(1).cast("long").alias("n")).distinct()
    kept = settle(heads.unionByName(wordless), "kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the row travels as one value, so that its column names meet no others
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    single = keyed.alias("a").join(kept.filter("n = 1").alias("b"), same, "left_semi").select("row.*")
    repeated = kept.filter("n > 1")
    if repeated.isEmpty():
        return single
    again = keyed.alias("a").join(repeated.alias("b"), same, "left_semi")
    one = again.groupBy("doc_id", "text_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return single.unionByName(one.select("row.*"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w
  FROM (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS t FROM documents)),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- equal sets are one vertex, so that copies give no pairs
v AS (SELECT doc_id, md5(string_agg(h, '' ORDER BY h)) AS v FROM s GROUP BY doc_id),
r AS (SELECT v, min(doc_id) AS r FROM v GROUP BY v),
sr AS (SELECT s.doc_id, s.h FROM s JOIN r ON s.doc_id = r.r),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM sr x JOIN sr y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (
  SELECT r AS node, r AS root FROM r
  UNION
  SELECT b, root FROM reach JOIN both_ways ON a = node),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN r ON v.v = r.v LEFT JOIN c ON c.node = r.r
"""
