"""Deliveries merged into a store by bucket."""

from pathlib import Path

import pytest

from bizlake.plans import financial, merging

SCHEMA = "cf string, anno string, value double"


@pytest.fixture
def store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merging, "BUCKETS", 8)
    root = str(tmp_path / "store")

    def deliver(rows):
        df = spark.createDataFrame(rows, SCHEMA)
        return merging.merge_statements(df, root), sorted(map(tuple, merging.statements(spark, root, df.schema).collect()), key=str)

    return deliver, Path(root) / "rows"


def _files(path):
    return {str(f.relative_to(path)) for f in path.rglob("part-*.parquet")}


def test_only_changed_buckets_are_written(store):
    deliver, path = store
    first = [(f"c{k}", "2022", float(k)) for k in range(40)]
    written, rows = deliver(first)
    assert written == list(range(8)) and rows == sorted(first, key=str)
    before = _files(path)
    assert deliver(first) == ([], rows) and _files(path) == before
    second = [("c7", "2023", 1.5) if r[0] == "c7" else r for r in first if r[0] != "c9"]
    written, rows = deliver(second)
    assert len(written) == 1
    assert rows == sorted([*second, ("c9", "2022", 9.0)], key=str)
    kept = {f for f in before if not f.startswith(f"_bucket={written[0]}/")}
    assert kept <= _files(path) and len(kept) >= 7


def test_same_rows_as_the_plain_carry_forward(spark, store):
    deliver, _ = store
    loads = [
        [(" a ", "1", 1.0), ("a", "1", 1.0), ("a", "1", 1.0), ("b", "1", None), ("", "1", 2.0), (None, "1", 3.0), ("d", None, 1.0)],
        [("b", "2", 5.0), ("b", "2", 5.0), ("c", "", None)],
        [("b", "2", 5.0), ("c", None, None)],
        [],
    ]
    previous = None
    for rows in loads:
        current = spark.createDataFrame(rows, SCHEMA)
        plain = financial.carry_forward(current, previous)
        want = sorted(map(tuple, plain.collect()), key=str)
        assert deliver(rows)[1] == want
        previous = spark.createDataFrame(want, SCHEMA)


def test_a_broken_run_is_made_good(store, monkeypatch):
    deliver, _ = store
    deliver([("a", "1", 1.0), ("b", "1", 1.0)])
    replace = merging._replace

    def breaks(rows, path):
        if path.endswith("digests"):
            raise OSError("lost")
        replace(rows, path)

    monkeypatch.setattr(merging, "_replace", breaks)
    with pytest.raises(OSError):
        deliver([("a", "2", 2.0)])
    monkeypatch.setattr(merging, "_replace", replace)
    # the digests still say that this is what is stored
    assert deliver([("a", "1", 1.0)])[1] == [("a", "1", 1.0), ("b", "1", 1.0)]
    assert deliver([("a", "1", 1.0)])[0] == []


def test_a_delivery_is_written_and_digested_once(store, monkeypatch):
    deliver, _ = store
    settled, digested = [], []
    settle, digests = merging.settle, merging._digests
    monkeypatch.setattr(merging, "settle", lambda df, label: settled.append((label, out := settle(df, label))) or out)
    monkeypatch.setattr(merging, "_digests", lambda df: digested.append(df) or digests(df))
    deliver([(f"c{k}", "2022", float(k)) for k in range(20)])
    settled.clear(), digested.clear()
    written, rows = deliver([("c7", "2023", 1.5), ("n1", "2023", 2.5)])
    assert ("c7", "2023", 1.5) in rows and ("c7", "2022", 7.0) not in rows and len(rows) == 21
    # only the delivery itself and the rows of vanished companies are written before the store
    with_rows = {label: df.count() for label, df in settled if "value" in df.columns}
    assert with_rows["delivery"] == 2 and sum(with_rows.values()) < 2 + 20 and set(with_rows) == {"delivery", "gone"}
    # companies of the delivery are not digested again
    assert digested[-1].filter("_id in ('c7', 'n1')").count() == 0
    assert deliver([("c7", "2023", 1.5), ("n1", "2023", 2.5)])[0] == []
