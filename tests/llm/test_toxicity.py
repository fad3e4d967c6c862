"""Toxicity: the scores by plain Python from the model's numbers, and held-out rows only."""

import math

import numpy as np
import pytest

from bizlake.llm import toxicity

WRAP = (1 << 64) - 1
BASE, MIX = int(toxicity.BASE), int(toxicity.MIX)


def slot(h, size):
    h = (((h ^ (h >> 32)) * MIX) + size) & WRAP
    return ((h * BASE & WRAP) >> 48) % toxicity.SLOTS


def slots(word):
    codes, found = [ord(c) for c in f"<{word}>"], []
    for n in toxicity.SIZES:
        for i in range(len(codes) - n + 1):
            h = 0
            for c in codes[i:i + n]:
                h = (h * BASE + c) & WRAP
            found.append(slot(h, n))
    return [*found, slot(sum(c * pow(BASE, k + 1, 1 << 64) for k, c in enumerate(codes)) & WRAP, 0)]


@pytest.mark.parametrize("letters", [4, 1 << 20])
def test_n_grams_by_plain_python(letters, monkeypatch):
    monkeypatch.setattr(toxicity, "LETTERS", letters)
    words = ["a", "idiot", "idi0t", "日本語", "x" * 50, "𝒳y", "a"]
    got = [[] for _ in words]
    for owner, found in toxicity.grams(words):
        for o, s in zip(owner.tolist(), found.tolist()):
            got[o].append(s)
    assert [sorted(g) for g in got] == [sorted(slots(w)) for w in words]
    assert list(toxicity.grams([])) == []
    assert [sorted(x) for x in [sum((f.tolist() for _, f in toxicity.grams(["a"])), [])]] == [sorted(slots("a"))]


def brute_score(model, text):
    """Highest stretch of 16 words, every 8 words and at the end; a word within 15 words of itself adds nothing."""
    part = model.part().astype(float)
    bias = float(model.bias[1] - model.bias[0])
    words = text.lower().split()
    value = [sum(part[s] for s in slots(w)) / len(slots(w)) for w in words]
    value = [0.0 if w in words[max(k - 15, 0):k] else v for k, (w, v) in enumerate(zip(words, value))]
    n = len(words)
    starts = [0] if n <= 16 else sorted({*range(0, n - 16, 8), n - 16})
    best = max((bias + sum(value[s:s + 16]) / min(n, 16) for s in starts), default=bias) if n else bias
    return 1 / (1 + math.exp(-(model.slope * best + model.shift)))


def test_scores_by_plain_python(frame):
    bad, good = "you utter vile idiot leave now", "the calm river runs past quiet green hills"
    rows = [(f"{good} {k} {good[k % 7:]} " * 3 + (f"{bad} {k}" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(90)]
    model = toxicity.fit(rows)
    texts = [bad, good, f"{good} " * 9 + bad, "", "é " * 20 + "ü", "idi0t vile " * 3, None, f"{bad} " * 40]
    scores = [r.score for r in toxicity.score(frame(texts), model).orderBy("doc_id").collect()]
    assert np.allclose(scores, [brute_score(model, t or "") for t in texts], atol=1e-6)
    assert scores[0] > toxicity.CUT > scores[1]
    # a passage anywhere in a long text counts, in scoring and in training
    assert scores[2] > toxicity.CUT


def test_training_covers_whole_texts():
    words = [f"w{k}" for k in range(5_000)]
    bags = toxicity._Bags([" ".join(words), "short text"])
    seen = {int(w) for row, owner in zip(bags.table, bags.owner) if owner == 0 for w in row if w >= 0}
    assert len(seen) == 5_000
