"""Filter audit and collocations against brute force."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from bizlake.llm import collocations as co
from bizlake.llm import interactions

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _failures(rows):
    """(part, id, failed letters) per row, by the letter of the conditions."""
    out = []
    for i, text, part in rows:
        t = text or ""
        words = WORD.findall(t)
        failed = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": re.search(r"[#$%&*|]", t) is not None,
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        out.append((part or "", i, {f for f in failed if failed[f]}))
    return out


def _audit_brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    found, out = _failures(rows), {}
    for part in {p for p, _, _ in found}:
        mine = [(i, f) for p, i, f in found if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                failing = sum(letter in f for _, f in mine)
                out[part, "".join(order), step] = (
                    len(left), len(gone), failing - len(gone), sum(f == {letter} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                )
        for (p, order, step), row in list(out.items()):
            if p == part:
                out[p, order, step] = (*row, shapley[order[step - 1]])
    return out


def _result(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, least long, digest string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = interactions.audit_documents(docs, marks).collect()
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}, len(got)


def test_audit(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(rng.choice([20, 400]))}" for _ in range(rng.randrange(30, 90))]
        if rng.random() < 0.4:
            words[0] = rng.choice(["#", "a|b", "UPPER" * 12])
        texts.append(" ".join(words))
    rows = [(k, rng.choice(texts), rng.choice(["s", "t", None])) for k in range(150)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 150, 2)]
    got, n = _result(spark, rows, labels)
    assert got == _audit_brute(rows, labels) and n == len(got)


def test_audit_odd(spark):
    long = " ".join(f"w{k}" for k in range(40_000))
    rows = [
        (0, None, None), (1, "", ""), (None, "", "s"), (2, long, "s"), (2, long, "s"), (3, long, "s"), (None, long, "s"),
        (4, "ÀÉ 日本 #", "s"), (5, "A" * 10, "t"), (5, "b", "t"),
    ]
    labels = [(2, 1, 0), (2, 0, 1), (None, 1, 1), (5, None, None)]
    got, n = _result(spark, rows, labels)
    assert got == _audit_brute(rows, labels) and n == 3 * 600
    assert _result(spark, [], [])[1] == 0


def test_gray_walk_is_every_subset():
    cells = np.random.default_rng(1).integers(0, 50, (3, 32))
    states = interactions.gray_walk(cells)
    for subset in range(32):
        assert (states[:, subset] == cells[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()


def _collocations_brute(rows, min_count, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, 6):
                for at in range(len(words) - k + 1):
                    key = (lang or "und", tuple(words[at : at + k]))
                    counts[key] = counts.get(key, 0) + 1
    big = {key: n for key, n in counts.items() if len(key[1]) > 1 and n >= min_count}
    covered = set()
    for (lang, words), n in big.items():
        for k in range(2, len(words)):
            for at in range(len(words) - k + 1):
                inner = (lang, words[at : at + k])
                if 100 * n >= 100 * counts[inner]:
                    covered.add(inner)
    out = []
    for lang in totals:
        rows = []
        for (at, words), a in big.items():
            if at != lang or (at, words) in covered:
                continue
            cuts = [(counts[lang, words[:k]], counts[lang, words[k:]], k) for k in range(1, len(words))]
            score, _, left, right = min(((1000 * a * totals[lang]) // (x * y), k, x, y) for x, y, k in cuts)
            rows.append((score, a, " ".join(words), left, right))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, x, y, totals[lang], s) for i, (s, a, p, x, y) in enumerate(rows[:top], 1)]
    return sorted(out)


def _prose(seed=7, n=300):
    rng = random.Random(seed)
    phrases = ["new york city hall", "a a a", "Out Of the Blue", "so to say", "état d’art", "in so far as it"]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(1, 25)):
            words += rng.choice(phrases).split() if rng.random() < 0.3 else [f"w{rng.randrange(30)}"]
            if rng.random() < 0.15:
                words[-1] += rng.choice([".", ",", "\n", "!?", "\x0b"])
        rows.append((rng.choice(["en", "de", None]), rng.choice([" ", "\t", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("top", [2000, 5])
def test_collocations(spark, top, monkeypatch):
    rows = _prose()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n long, words string").repartition(3)
    monkeypatch.setattr(co, "CHUNK_BYTES", 2000)
    got = sorted(map(tuple, co.collocations(docs, min_count=20, top=top).collect()))
    assert got == _collocations_brute(rows, 20, top) and len(got) >= 15


def test_collocations_whatever_the_sieve_lets_through(spark, monkeypatch):
    """Bits that all meet make windows longer, not results different."""
    rows = _prose(seed=8, n=80)
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(co, "_holds", lambda sieve, hashes: np.ones(len(hashes), dtype=bool))
    assert sorted(map(tuple, co.collocations(docs, min_count=8).collect())) == _collocations_brute(rows, 8, 2000)


def test_collocations_odd(spark, odd, monkeypatch):
    assert co.collocations(odd.limit(0), min_count=2).count() == 0
    assert co.collocations(odd, min_count=10**6).count() == 0
    monkeypatch.setattr(co, "CHUNK_BYTES", 1000)
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(map(tuple, co.collocations(odd, min_count=12).collect())) == _collocations_brute(rows, 12, 2000)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(co, "CHUNK_BYTES", 10)
    text = b"one two three four. five six, seven eight nine ten eleven twelve;"
    parts = list(co._slices(text))
    assert b"".join(parts) == text and len(parts) > 2 and all(p == b"" or p[-1:] in b".,;" for p in parts)
