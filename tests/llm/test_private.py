"""Private data against plain Python: text around spans, disclosure, long texts, clashing names."""

import math
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bizlake.llm import privacy

NAMES = ["_id", "_digest", "_hash", "_spans", "_kept", "_text_hash", "row", "spans", "digest", "id"]


@pytest.fixture
def clashing(odd):
    """The odd rows with columns named as operators might name their own."""
    return odd.withColumns({name: F.concat_ws("-", F.lit(name), "doc_id", "text") for name in NAMES})


@pytest.mark.parametrize("block", [2, 256])
def test_replaced_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(privacy, "BLOCK", block)
    text = "äb日" * 40
    spans = [(0, 3), (1, 2), (2, 9), (20, 21), (21, 40), (25, 119), (30, 31), (119, 120)]
    want, covered = list(text), set()
    for start, end in spans:
        covered |= set(range(start, end))
    want = "".join(" " if i in covered else c for i, c in enumerate(text))
    rows = [(text, [{"start": a, "end": b, "kind": "k", "value": text[a:b]} for a, b in spans]), ("none", [])]
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,end:int,kind:string,value:string>>")
    blanked = [r[0] for r in df.select(privacy._blanked(F.col("text"), F.col("spans"))).collect()]
    assert blanked == [want, "none"]
    around = df.select(privacy._contexts(F.col("text"), F.col("spans")).alias("c"), F.transform(
        "spans", lambda s: F.xxhash64(
            F.substring("text", F.greatest(s["start"] - privacy.REACH, F.lit(0)) + 1, F.least(s["start"], F.lit(privacy.REACH))),
            F.substring("text", s["end"] + 1, F.lit(privacy.REACH))),
    ).alias("want")).collect()
    for row, (_, given) in zip(around, rows):
        assert [c.value for c in row.c] == ["k:" + s["value"] for s in given]
        assert [c.context for c in row.c] == row.want


def brute_disclosures(texts):
    """term: disclosure, for values written as mail addresses in texts without repeated rows."""
    words = [set(re.findall(r"[a-z]+", re.sub(r"\S+@\S+", lambda m: " " * len(m[0]), t))) for t in texts]
    every = [set(re.findall(r"[a-z]+", t)) for t in texts]
    held = {}
    for n, t in enumerate(texts):
        for m in re.finditer(r"\S+@\S+", t):
            around = (t[max(m.start() - privacy.REACH, 0):m.start()], t[m.end():m.end() + privacy.REACH])
            held.setdefault(m[0], {}).setdefault(n, around)
    best = {}
    for docs in held.values():
        for term in set().union(*(words[n] for n in docs)):
            seen = [n for n in docs if term in words[n]]
            if len({docs[n] for n in seen}) >= privacy.SUPPORT:
                told = math.log2(len(texts) / len(docs))
                share = math.log2(len(seen) * len(texts) / (sum(term in e for e in every) * len(docs))) / told if told else 0.0
                best[term] = max(best.get(term, 0.0), share)
    return {t: d for t, d in best.items() if d >= privacy.GENERALISE}


def test_disclosure_by_brute_force(frame):
    texts = [f"day{chr(97 + n % 26)} plain {chr(97 + n // 26)}x words here" for n in range(300)]
    for n in range(8):
        texts.append(f"zorro rides {'abcdefgh'[n] * 5} tonight mail z@a.org or {'the' if n % 2 else 'any'} stable zorro")
    texts += ["a zorro far away", "copy of b@a.org same words", "copy of b@a.org same words too", "words b@a.org rare", "q@a.org once"]
    want = brute_disclosures(texts)
    found = privacy.keyed_text(frame(texts)).withColumn("spans", privacy.base_spans(F.col("text")))
    got = {r.term: r.disclosure for r in privacy.disclosures(found).collect()}
    assert want and got.keys() == want.keys()
    assert all(abs(got[t] - want[t]) < 1e-9 for t in want)


def _disclosing(frame):
    texts = [f"day{chr(97 + n % 26)} plain {chr(97 + n // 26)}x words here" for n in range(300)]
    return frame(texts + [f"zorro rides {'abcdefgh'[n] * 5} tonight mail z@a.org stable {'abcdefgh'[n] * 3}" for n in range(8)])


def test_other_words_are_left_out_before_they_are_counted(spark, frame, monkeypatch):
    found = privacy.keyed_text(_disclosing(frame)).withColumn("spans", privacy.base_spans(F.col("text")))
    want = {(r.term, r.disclosure) for r in privacy.disclosures(found).collect()}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = privacy.disclosures(found)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "zorro" in {term for term, _ in want} and {(r.term, r.disclosure) for r in few.collect()} == want
        # below the first count, not above it
        assert "BroadcastHashJoin" in plan and plan.rindex("partial_count") < plan.index("LeftSemi")
        monkeypatch.setattr(privacy, "TERMS_SENT", 0)
        assert {(r.term, r.disclosure) for r in privacy.disclosures(found).collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_texts_stay_where_they_are_while_few_disclose(frame):
    found = privacy.find_private(_disclosing(frame))
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.filter("size(terms) > 0").count() == 8


def test_copies_of_a_passage_count_once(frame):
    passage = "call the hidden falcon at f@a.org before dawn " * 2
    texts = [f"w{n} other text" for n in range(60)] + [passage + "x" * n for n in range(70, 76)]
    found = privacy.keyed_text(frame(texts)).withColumn("spans", privacy.base_spans(F.col("text")))
    assert "falcon" not in {r.term for r in privacy.disclosures(found).collect()}


def test_time_grows_with_the_text(frame):
    """Many values in one text, and one value in many places, take time in proportion to the text."""

    def seconds(text):
        begin = time.time()
        row = privacy.sanitise(frame([text, text + " x", text + " y z", "other"])).orderBy("doc_id").first()
        assert "@" not in row.text and "[EMAIL]" in row.text
        return time.time() - begin

    many = lambda n: " ".join(f"word{k} n{k}@a{k}.org é" for k in range(n))
    same = lambda n: " ".join(f"word{k} one@a.org é" for k in range(n))
    seconds(many(10))
    for make in many, same:
        small, large = seconds(make(2_500)), seconds(make(25_000))
        assert large < 12 * small, (small, large)


@pytest.mark.parametrize("name", ["exact_dedup", "private_data", "near_dedup"])
def test_clashing_names(spark, clashing, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, clashing, str(tmp_path))
    assert out.columns == clashing.columns
    assert all(r[n].startswith(n) for r in out.collect() for n in NAMES)
    assert stage(spark, clashing.limit(0), str(tmp_path)).count() == 0
