"""The five stages over a small table, against what each has to keep."""

import corpus_pipeline


def test_stages(spark, frame, tmp_path):
    base = "The quick brown fox jumps over the lazy dog and runs along the river until night falls on the hills".split()
    near = " ".join([*(base * 3), "again"])
    texts = [" ".join(base), " ".join(base) + "\n", " ".join(base * 3), near, "123 456", None, "mail me at a@b.org please my friend"]
    frame(texts).write.parquet(str(tmp_path / "documents.parquet"))
    docs, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(sorted(r.doc_id for r in docs.collect()))
    assert sizes[0] == [0, 1, 2, 3, 6]
    assert 6 in sizes[-1] and not docs.filter("text like '%a@b.org%'").count()
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in packed}) == sizes[-1]


def test_exact_stage_with_odd_ids(spark, odd, frame, tmp_path):
    rows = corpus_pipeline.exact_dedup(spark, odd, str(tmp_path)).collect()
    texts = sorted(" ".join(r.text.split()) if r.text else "" for r in rows)
    want = {" ".join((r.text or "").split()) for r in odd.collect()}
    assert set(texts) == want and [r.doc_id for r in rows if r.text and r.text.startswith("Ünï")] == [None]
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [0, 2, 3, 4, 5, 7]
    again = frame(["p q", "p  q", "p q", "r", "s"], [None, None, None, 1, 1])
    rows = corpus_pipeline.exact_dedup(spark, again, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, " ".join(r.text.split())) for r in rows) == [(0, "p q"), (1, "r"), (1, "s")]


def test_near_stage_with_odd_ids(spark, odd, frame, tmp_path):
    words = " ".join(f"w{k}" for k in range(60))
    texts = [words, words, words, words + " more", "p q r s t u", "p q r s t u", "other words of this text stand here", None, "", " "]
    rows = corpus_pipeline.near_dedup(spark, frame(texts, [None, None, None, None, 5, 5, 5, 8, 8, 9]), str(tmp_path)).collect()
    left = sorted((r.doc_id or 0, len((r.text or "").split())) for r in rows)
    assert left in ([(0, n), (5, 6), (5, 7), (8, 0), (8, 0), (9, 0)] for n in (60, 61))
    rows = corpus_pipeline.near_dedup(spark, frame([words, words, words + " more"], [None, 7, 3]), str(tmp_path)).collect()
    assert [r.doc_id for r in rows] == [3]
    assert corpus_pipeline.near_dedup(spark, odd.limit(0), str(tmp_path)).columns == odd.columns
