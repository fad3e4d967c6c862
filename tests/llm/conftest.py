import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """documents-like table of texts; ids are their places unless given."""

    def make(texts, ids=None, lang="en"):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, lang, "s", len(t or "")) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls, empty and long texts, repeated rows, ids that repeat or are missing."""
    long = " ".join(f"w{k % 5003}" for k in range(30_000))
    texts = [None, "", " \n ", "a", "b " * 40, long, long, "x y z", "x y z", "Ünï 日本 " * 60]
    return frame(texts, [0, 1, 2, 3, 4, 5, 6, 7, 7, None])
