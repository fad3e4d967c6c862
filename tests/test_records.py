"""Quoted files cut into many splits, against the reader that takes a file whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bizlake.sources import delimited, records


@pytest.fixture
def splits(spark):
    """Splits of so many bytes while the test runs."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def cut(size):
        for name in names:
            spark.conf.set(name, str(size))

    yield cut
    for name in names:
        spark.conf.unset(name)


def _whole(spark, path, sep=";"):
    reader = spark.read.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"')
    return reader.option("multiLine", True).csv(path)


def _file(seed, rows=60, end="\n", sep=";"):
    rng = random.Random(seed)
    cells = ["", "a", "plain text", 'he said "no"', "two\nlines", "three\n\nlines; of\n", '"', '5" pipe', "x;y", "é 日本", " lead"]

    def cell():
        text = rng.choice(cells)
        if any(c in text for c in '"\n;') and text != '5" pipe':
            return '"' + text.replace('"', '""').replace("\n", end) + '"'
        return text

    lines = [f"id{sep}a{sep}b"] + [sep.join([str(k), cell(), cell()]) for k in range(rows)]
    return lines


@pytest.mark.parametrize("size", [400, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_are_those_of_the_whole_reader(spark, tmp_path, splits, size, end):
    for seed in range(2):
        path = tmp_path / f"{seed}.csv"
        path.write_bytes(end.join([*_file(seed, end=end), ""]).encode())
    splits(1 << 20)
    want = sorted(_whole(spark, str(tmp_path)).collect(), key=str)
    splits(size)
    found = delimited.read_delimited(spark, str(tmp_path), ";", blanks="keep", row_number="n")
    rows = found.orderBy("n").collect()
    assert sorted([tuple(c or "" for c in r) for r in want]) == sorted([tuple(r)[:3] for r in rows])
    assert [r.n for r in rows] == list(range(1, 121)) and [int(r.id) for r in rows] == [*range(60), *range(60)]


def test_one_file_gives_several_tasks(spark, tmp_path, splits):
    path = tmp_path / "one.csv"
    path.write_text("\n".join(_file(5, rows=400)) + "\n")
    splits(2500)
    lines = records._lines(spark, str(path), ";")
    assert lines.rdd.getNumPartitions() > 3
    opened = records._starts(lines).filter("_open").count()
    assert opened >= 1  # some splits begin inside quotes
    parts = records.read_records(spark, str(path), ";")
    assert parts.filter(~F.col("_header")).count() == 400
    assert parts.filter("not _header").select("_block").distinct().count() > 3


def test_a_record_over_many_splits(spark, tmp_path, splits):
    cell = "\n".join(f'line {k} ""quoted"" ; x' for k in range(200))
    path = tmp_path / "long.csv"
    path.write_text(f'id;text\n1;"{cell}"\n2;after\n\n3;"{cell}"')
    splits(1200)
    rows = delimited.read_delimited(spark, str(path), ";", row_number="n").orderBy("n").collect()
    assert [(r.id, r.n) for r in rows] == [("1", 1), ("2", 2), ("3", 3)]
    assert rows[0].text == rows[2].text == cell.replace('""', '"') and rows[1].text == "after"


def test_long_records_are_skipped_across_splits(spark, tmp_path, splits):
    lines = [f'{k};"a\nb";c' + (";more" if k % 5 == 0 else "") for k in range(100)] + ["100;short"]
    (tmp_path / "x.csv").write_text("id;p;q\n" + "\n".join(lines) + "\n")
    splits(400)
    rows = delimited.read_skipping_long_lines(spark, str(tmp_path / "x.csv"), row_number="n").orderBy("n").collect()
    assert [int(r.id) for r in rows] == [k for k in range(101) if k % 5 or k == 100]
    assert [r.n for r in rows] == [int(r.id) + 1 for r in rows] and rows[-1].q is None


def test_odd_files(spark, tmp_path):
    for name, text, want in (
        ("none", "a;b\n", []), ("open", 'a;b\n1;"never\nclosed;', [("1", "never\nclosed;")]),
        ("late", 'a;b\n1;"x"tail\n2;y\n', [("1", '"x"tail'), ("2", "y")]), ("mark", '﻿a;b\n1;2\n', [("1", "2")]),
    ):
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        got = sorted(tuple(r) for r in delimited.read_delimited(spark, str(path), ";", blanks="keep").collect())
        assert got == want, name
        assert sorted(tuple(c or "" for c in r) for r in _whole(spark, str(path)).collect()) == want, name


def test_different_headers_stop_the_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;name\n1;x\n")
    (tmp_path / "b.csv").write_text("name;id\nx;1\n")
    with pytest.raises(delimited.HeaderError, match="different headers"):
        delimited.read_delimited(spark, str(tmp_path), ";")


def test_states_run_through_any_lines():
    rng = np.random.default_rng(2)
    for _ in range(50):
        out, within = rng.integers(0, 2, (2, 40)).astype(np.int8)
        for start in (0, 1):
            state, want = start, []
            for a, b in zip(out, within):
                state = int(b if state else a)
                want.append(state)
            assert records.states(out, within, start).tolist() == want
