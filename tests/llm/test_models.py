"""Fitted operators: brute force for what is exact, held-out rows for what is learnt."""

import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bizlake.llm import languages, privacy, quality, scoring, toxicity
from bizlake.llm.bpe import Cutter
from bizlake.llm.common import documents, held_out

import public_tokenizers

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, FOLDER)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def _luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def _private(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(digits(v)) <= 19 and _luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    ]
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, good) in enumerate(kinds) for m in re.finditer(p, text) if good(m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def test_base_spans(docs, texts, frame):
    rows = docs.select("doc_id", privacy._written(privacy.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
    assert all(r.s == _private(texts[r.doc_id]) for r in rows)
    hard = ["a@b.c_d@e.f", "1.2.3.999.5.6.7.8", "4111 1111-1111 1111", "é😀+1 (234) 567-8901.", "5--4111111111111111", "1." * 3000]
    rows = frame(hard).select("doc_id", privacy._written(privacy.base_spans(F.col("text"))).alias("s")).orderBy("doc_id").collect()
    assert [r.s for r in rows] == [_private(t) for t in hard]


def test_disclosing_terms(frame):
    told = [f"note {w} Zyxwvu writes to q@x.org from {w}" for w in ("red", "blue", "green", "pink")]
    clean = [f"note number {w} has nothing to hide from anyone" for w in "abcdefghijklmnopqrstuvwx"]
    found = {r.doc_id: r for r in privacy.find_private(frame(told + clean)).collect()}
    for k, text in enumerate(told):
        terms = {text[s.start : s.end] for s in found[k].terms}
        assert "Zyxwvu" in terms and "from" not in terms and "note" not in terms
    assert not any(found[k].terms for k in range(len(told), len(told) + len(clean)))
    masked = privacy.sanitise(frame(told + clean)).orderBy("doc_id").collect()
    assert "q@x.org" not in masked[0].text and "Zyxwvu" not in masked[0].text and "[EMAIL]" in masked[0].text
    assert [r.text for r in masked[len(told):]] == clean


def test_disclosing_terms_far_from_the_value(frame):
    far = " ".join(["nothing to hide here"] * 9)
    told = [f"note {w} {far} Zyxwvu writes {far} to q@x.org from {w} {far} zyxwvu" for w in ("red", "blue", "green", "pink")]
    clean = [f"note number {w} writes to {far} from home" for w in "abcdefghijklmnopqrstuvwx" * 40]
    alone = "note that Zyxwvu writes to nobody"
    docs = frame([*told, alone, *clean])
    found = {r.doc_id: r for r in privacy.find_private(docs).collect()}
    for k, text in enumerate([*told, alone]):
        assert [text[s.start : s.end] for s in found[k].terms if text[s.start : s.end].lower() == "zyxwvu"] == re.findall("(?i)zyxwvu", text)
    assert not any(found[k].terms for k in range(5, 5 + len(clean)))
    masked = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    assert not any("zyxwvu" in masked[k].lower() for k in range(5)) and [masked[5 + k] for k in range(len(clean))] == clean


def test_private_odd(odd):
    assert privacy.find_private(odd).count() == odd.count()
    assert privacy.sanitise(odd).columns == odd.columns and privacy.sanitise(odd.limit(0)).count() == 0


def test_quality_statistics():
    text = "a b c\na b c\n\n### d | e"
    words = text.split()
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for k in range(3)}
    assert quality.measure(text)[0] == [len(words), len("".join(words)), 4, 1, len(covered)]
    assert quality.measure("")[0] == [0, 0, 0, 0, 0]


def test_quality_keeps_good_rows(docs, labels, odd):
    rows = quality.judge(docs, labels).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    kept = {r.quality: r.k for r in rows.collect()}
    assert kept[1] > 0.97 and kept[0] < 0.5
    assert quality.judge(odd, labels.limit(0)).count() == odd.count()


def test_quality_learns_from_all_labelled_rows(spark):
    n = 4_100
    ids = [r.id for r in spark.range(n).orderBy(F.xxhash64("id"), "id").collect()]
    bad = set(ids[4_000:])  # beyond the first 4,000 in the order of their hashes
    rows = [(i, " ".join(f"w{i}x{k}" + (" ##" if i in bad else "") for k in range(60))) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i not in bad)) for i in range(n)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.judge(docs, marks).filter("kept or base_failed").collect()}
    assert not kept & bad and len(kept) >= 0.99 * (n - len(bad))


def test_toxicity(docs, labels, odd):
    model = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").select("score", "toxic", held_out("doc_id", 4).alias("held")).collect()
    clean = [r.score >= toxicity.CUT for r in rows if r.held and not r.toxic]
    assert sum(clean) <= 0.06 * len(clean)
    found = [r.score >= toxicity.CUT for r in rows if r.held and r.toxic]
    assert sum(found) >= 0.5 * len(found)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(odd, toxicity.fit([])).count() == odd.count()


def test_languages(docs, odd):
    model = languages.learn(docs)
    rows = languages.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out("doc_id", 4)).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    rows = {r.doc_id: r for r in languages.predict(odd, model).collect()}
    assert [rows[k].lang_pred for k in (0, 1, 2)] == ["und"] * 3 and len(rows) > 3
    assert languages.predict(odd, languages.learn(odd.limit(0))).filter("lang_pred <> 'und'").isEmpty()


def test_scores(docs, texts):
    flagged = docs.select("doc_id", "text", held_out("doc_id", 7).alias("held"))
    rows = scoring.score_texts(flagged, "held", public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    words = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    count = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total = sum(count.values())
    for r in rows:
        want = sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in words[r.doc_id])
        assert math.isclose(want, r.base_score, rel_tol=1e-9) and r.train_tokens == total
        assert r.n_tokens == len(words[r.doc_id]) and r.n_known == sum(count[w] > 0 for w in words[r.doc_id])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_odd(odd):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = scoring.score_texts(odd.withColumn("held", F.lit(False)), "held", path).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert scoring.score_texts(odd.limit(0).withColumn("held", F.lit(False)), "held", path).count() == 0


def test_training_reaches_every_token(monkeypatch):
    sizes = np.array([300_000, 0, 7, 40_000], dtype=np.int64)  # the last text is held out
    text = np.arange(sizes.sum(), dtype=np.int32) % 50
    docs = scoring._pack(np.arange(4), np.zeros(4, np.uint8), np.array([0, 0, 0, 1], np.uint8), sizes, text)
    found = scoring._pack(np.arange(50, dtype=np.int32), np.full(50, 6_000), np.arange(50, dtype=np.int32), np.ones(50, np.uint8))
    seen = Counter()

    def train(self, windows, targets, real, rate, moments):
        seen.update(targets[real].tolist())

    monkeypatch.setattr(scoring.Attention, "train", train)
    classes = scoring.Classes({k: (6_000, 1) for k in range(50)}, 3, 50)
    run = scoring._training(None, classes, 0)
    run(pa.table({"block": [0], "docs": [docs]}), pa.table({"block": [0], "found": [found]}))
    assert seen == Counter(classes.of[text[:300_007]].tolist()) + Counter({0: 3})


def test_training_reaches_every_subword_id(monkeypatch):
    sizes = np.array([50_000, 3, 900], dtype=np.int64)  # the last text is held out
    text = np.arange(sizes.sum(), dtype=np.int32) % 3
    docs = scoring._pack(np.arange(3), np.zeros(3, np.uint8), np.array([0, 0, 1], np.uint8), sizes, text)
    words = [[0], [1, 7, 8], [0, 9]]
    ids, lens = np.concatenate(words).astype(np.int32), np.array([len(w) for w in words], np.int32)
    found = scoring._pack(
        np.arange(3, dtype=np.int32), np.array([5, 6, 7]), ids, np.empty(0, np.uint8), lens, np.array([12, 6, 6, 6, 12, 7])
    )
    seen, given = Counter(), set()

    def train(self, windows, targets, real, rate, moments):
        seen.update(targets[real].tolist())
        given.update(windows[real].tolist())

    monkeypatch.setattr(scoring.Attention, "train", train)
    classes = scoring.Classes({k: (100 + k, 1) for k in range(10)}, 2, 10, np.arange(10) < 2)
    scoring._training(None, classes, 0)(pa.table({"block": [0], "docs": [docs]}), pa.table({"block": [0], "found": [found]}))
    assert seen == Counter(classes.of[k] for w in text[:50_003] for k in words[w]) + Counter({0: 2})
    assert given == {0, 1, 7, 8, 9, 10}


def test_all_ids_of_a_word_count(frame):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = ["the house and the garden of the king"] * 20 + ["xqzjkva the king", "xqzjkwb the king", "the house", "the housf"]
    docs = frame(texts).withColumn("held", F.col("doc_id") >= 20)
    rows = {r.doc_id: r for r in scoring.score_texts(docs, "held", path).collect()}
    # unknown words that begin alike
    assert rows[20].base_score == rows[21].base_score and rows[20].ids_score != rows[21].ids_score
    assert rows[20].score != rows[21].score  # what comes after them is told from all their ids
    assert all(r.ids_score < 0 and r.score < 0 for r in rows.values())
    assert rows[22].ids_score > rows[23].ids_score and rows[22].score > rows[23].score


def test_scores_are_probabilities_of_what_follows():
    words = [[0], [0, 3], [0, 3, 4], [1]]  # ids 0 and 1 open a word, 2 to 4 go on
    ids, lens = np.concatenate(words).astype(np.int32), np.array([len(w) for w in words], np.int32)
    count, passing = np.array([4, 2, 1, 5]), np.array([7, 7, 3, 7, 3, 1, 5])
    spelling = scoring.Spelling(pa.table({"found": [scoring._pack(np.arange(4, dtype=np.int32), count, ids, np.empty(0, np.uint8), lens, passing)]}))
    tally = {0: (7, 1), 1: (5, 1), 3: (3, 1), 4: (1, 1)}
    classes = scoring.Classes(tally, 3, 5, np.arange(5) < 2)
    assert classes.tokens == 15 and classes.words == 5
    head = np.bincount(classes.of, 10**classes.inside, scoring.CLASSES)  # ids share their class whole
    assert np.allclose(head[head > 0], 1)
    # after [0]: 3 of 7 go on with id 3, 4 end; after [0, 3]: 1 of 3 goes on with id 4, 2 end
    assert spelling.before.tolist() == [0, 0, 7, 0, 7, 3, 0, 0] and np.allclose(spelling.share[[2, 5]], [3 / 7, 1 / 3])
    assert np.allclose(spelling.end_share[:4], [4 / 7, 2 / 3, 1, 1])


def test_large_ids_stand_beside_missing_ones(frame):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = [9007199254740993, None, 9007199254740995, 1]
    docs = frame(["one two three", "two three", "three one", "one"] * 3, ids * 3).withColumn("held", F.lit(False))
    rows = scoring.score_texts(docs, "held", path).collect()
    assert Counter(r.doc_id for r in rows) == Counter(ids * 3)


def test_numerals_are_no_letters(docs, frame):
    assert [languages.has_letter(t) for t in ("²½①", "Ⅷ 12 _", "", "½ a", "日", "ª")] == [False, False, False, True, True, True]
    rows = languages.predict(frame(["²½①", "the and of the house"]), languages.learn(docs)).orderBy("doc_id").collect()
    assert rows[0].lang_pred == "und" and rows[1].lang_pred == "en"


def test_blocks_hold_no_number_that_can_be_worked_out(monkeypatch):
    """Word ids travel without the places of their beginnings, numbers without their empty bytes."""
    monkeypatch.setattr(scoring, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [" ".join(f"w{k}{'xyz'[k % 3] * (k % 7)}" for k in range(at, at + 4000)) for at in range(0, 20_000, 2000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10)), "held_out": [k == 3 for k in range(10)], "text": texts})
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    left = pa.Table.from_batches(list(scoring._blocks(path, public_tokenizers.PATTERN)(iter([batch]))))
    raw = scoring.unsqueeze(left["spelt"][0].as_py())
    lens = np.frombuffer(raw[8:24], dtype=np.int64)
    assert np.frombuffer(raw[:8], dtype=np.int64)[0] == 2  # lengths and ids
    assert len(raw) == 24 + lens.sum()
    counts = np.arange(100_000) % 50
    assert len(scoring._pack(counts)) < len(scoring.squeeze(counts.astype(np.int32).tobytes()))
    for values in (counts, np.empty(0, np.uint64), np.array([2**63 + 5, 1], np.uint64), np.array([-3, 7], np.int32)):
        (back,) = scoring._unpack(scoring._pack(values), values.dtype.type)
        assert back.dtype == values.dtype and (back == values).all()
    # counts of beginnings that come back by bucket stand with the ids that end them
    rows = sorted(scoring._lists(7)(iter(left.to_batches())), key=lambda b: b["bucket"][0].as_py())
    right = pa.Table.from_batches(list(scoring._counted(iter(rows))))
    spelling = scoring.Spelling(scoring._once(7)(left, right))
    held = [w for k, text in enumerate(texts) if k != 3 for w in text.split()]
    n, passing = Counter(held), Counter()
    cutter, *_ = scoring._byte_bpe(path, public_tokenizers.PATTERN)
    words = list(dict.fromkeys(w for text in texts for w in text.split()))
    ids = [np.frombuffer(b, "<i4").tolist() for b in cutter([" " + w for w in words])]
    for word, own in zip(words, ids):
        for k in range(len(own)):
            passing[tuple(own[: k + 1])] += n[word]
    assert spelling.count.tolist() == [n[w] for w in words]
    assert spelling.passing.tolist() == [passing[tuple(own[: k + 1])] for own in ids for k in range(len(own))]


def test_white_space_next_to_a_blank_is_seen():
    for mark in [chr(c) for c in range(0x3001) if chr(c).isspace()]:
        assert Cutter.close(f"a {mark}b") and Cutter.close(f"a{mark} b"), hex(ord(mark))
        assert not Cutter.close(f"a{mark}b c") or mark == " "
    assert not Cutter.close("a b \u00e8 \u65e5\u672c")


def test_workers_that_train_hold_no_vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    scoring._byte_bpe(path, public_tokenizers.PATTERN)
    assert list(scoring._lists(3)(iter([]))) == []
    assert scoring._byte_bpe.cache_info().currsize == scoring.load_ranks.cache_info().currsize == 0
    windows = scoring.Windows(np.arange(40, dtype=np.int32), np.array([40]), 50)
    assert windows.ids.dtype == np.int32 and windows.cut(np.array([0]))[0].tolist() == [[50, *range(15)]]
