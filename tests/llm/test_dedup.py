"""Exact, substring and similarity dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bizlake.llm import copies, jaccard, substrings


def _substring_brute(texts):
    words = [(t or "").encode().split() for t in texts]
    windows = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - 34) if windows[tuple(w[i : i + 35])] > 1 for k in range(35)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def _mixed(n=40, seed=3):
    rng = random.Random(seed)
    draw = lambda k: [f"w{rng.randrange(300)}" for _ in range(k)]
    passage, texts = draw(60), []
    for k in range(n):
        body = draw(rng.randrange(1, 160))
        if k % 3 == 0:
            at = rng.randrange(len(body) + 1)
            body = body[:at] + passage[: rng.randrange(30, 61)] + body[at:]
        texts.append((" " if k % 2 else "\n").join(body))
    near = texts[1].split()
    return [*texts, texts[0], " ".join(near[:-2]), " ".join(["r"] * 90)]


def test_substrings(frame):
    texts = _mixed()
    rows = substrings.remove_repeated(frame(texts)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in rows] == _substring_brute(texts)


def test_hot_minimisers_are_cut_up(frame, monkeypatch):
    texts = _mixed(seed=5)
    monkeypatch.setattr(substrings, "_pack", lambda hot, n, pack=substrings._pack: pack(hot | True, n))
    rows = substrings.remove_repeated(frame(texts)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in rows] == _substring_brute(texts)


def test_substrings_odd(odd):
    rows = substrings.remove_repeated(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: r.n_removed for r in rows}[5] == 30_000
    assert substrings.remove_repeated(odd.limit(0)).count() == 0


def test_exact_groups_with_any_digest(frame):
    texts = ["a  b", "a b", None, "", "A b", "a\n b", "c", "a b "]
    want = [(0, 3), (0, 3), (2, 2), (2, 2), (4, 1), (0, 3), (6, 1), (7, 1)]
    for digest in (copies._sha256, lambda t: F.length(t).cast("string")):
        rows = copies.exact_groups(frame(texts), digest=digest).orderBy("doc_id").collect()
        assert [(r.keep_id, r.group_size) for r in rows] == want
        assert [r.kept for r in rows] == [r.doc_id == r.keep_id for r in rows]


def test_exact_odd(odd):
    assert copies.exact_groups(odd).count() == odd.count()
    assert copies.exact_groups(odd.limit(0)).count() == 0


def _components_brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_similar_sets(frame):
    rng = random.Random(11)
    texts = []
    for size in (4, 9, 12, 30, 60, 200, 400):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(9):  # chains of edits, near the threshold and far from it
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(max(1, size // rng.choice([60, 45, 30, 20]))):
                base[rng.randrange(size)] = f"e{rng.randrange(5000)}"
    texts += [None, "", "One two", "one TWO", texts[0].upper()]
    rows = jaccard.similar_sets(frame(texts)).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in rows] == _components_brute(texts)


def test_similar_sets_with_a_common_passage(frame, monkeypatch):
    """A passage makes most of many texts: pairs meet in small parts and cells, none is lost."""
    rng = random.Random(23)
    draw = lambda k: [f"w{rng.randrange(9000)}" for _ in range(k)]
    passage, texts = draw(100), []
    for k in range(120):
        own = draw(rng.choice([6, 9, 13, 20, 30]))
        texts.append(" ".join(passage + own))
        if k % 4 == 0:  # a near copy of this one
            own[rng.randrange(len(own))] = "other"
            texts.append(" ".join(passage + own))
    chain = draw(150)
    for _ in range(40):  # each links with the next, the ends do not
        texts.append(" ".join(chain))
        chain = chain[4:] + draw(4)
    rng.shuffle(texts)
    monkeypatch.setattr(jaccard, "NEAREST", 4)
    monkeypatch.setattr(jaccard, "CELL", 8)
    rows = jaccard.similar_sets(frame(texts)).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in rows] == _components_brute(texts)


def test_first_slices_hold_an_equal_one():
    """Whatever the order of slices, linking sets are looked up by a common key."""
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 5, 9, 10, 11, 40, 150, 700):
        for _ in range(20):
            common = rng.integers(0, 1 << 63, size=n).astype(np.uint64)
            extra = rng.integers(0, 1 << 63, size=rng.integers(0, n // 4 + 1)).astype(np.uint64)
            one, two = common, np.concatenate([common, extra])  # n of at most 5/4 n
            cut = rng.integers(0, (n + len(extra)) // 9 + 1)
            one = np.concatenate([one[cut:], rng.integers(0, 1 << 63, size=cut).astype(np.uint64)])
            both = len(np.intersect1d(one, two))
            if 100 * both < 80 * (len(one) + len(two) - both):
                continue
            hashes, owner = np.concatenate([one, two]), np.repeat([0, 1], [len(one), len(two)])
            ranks = rng.integers(0, 255, size=jaccard.SLOTS).astype(np.uint8)
            key, text = jaccard._slice_keys(hashes, owner, 2, ranks)
            assert len(np.intersect1d(key[text == 0], key[text == 1]))


def test_similar_odd(odd):
    rows = jaccard.similar_sets(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id == 6} == {5}
    assert jaccard.similar_sets(odd.limit(0)).count() == 0
