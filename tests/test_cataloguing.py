"""What is known of a folder: types by bits, parts with different headers, only changed files read."""

import datetime as dt
import gzip
import hashlib
import json
import os
from pathlib import Path

import pytest

from bizlake.plans import cataloguing, jobs, loading
from bizlake.plans.catalogue import profile
from bizlake.sources import files

NOW = dt.datetime(2024, 6, 30, 12, 0)


def cells(spark, root):
    found = cataloguing.dataset_columns(cataloguing.known(spark, str(root)))
    return {(r.file, r.column_name): (r.dtype, r.filled, r.row_count, r.column_count) for r in found.collect()}


def names(paths):
    return sorted(p.rsplit("/", 1)[1] for p in paths)


def test_types_are_those_of_the_profile(spark, tmp_path):
    columns = {"whole": ["1", "-2", "+3"], "gaps": ["1", None, "2"], "decimal": ["1.5", "2", "1e3"], "flag": ["True", "false", "true"],
               "flag_gaps": ["true", None, "false"], "text": ["a", "1", "2"], "mixed": ["true", "1", "2"], "none": [None, None, None]}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} string" for c in columns))
    folder = tmp_path / "in"
    folder.mkdir()
    lines = ["|".join(columns), *("|".join(v or "" for v in row) for row in zip(*columns.values()))]
    (folder / "t.csv").write_text("\n".join(lines) + "\n")
    cataloguing.update(spark, str(folder), str(tmp_path / "known"))
    want = {("t.csv", r.column_name): (r.dtype, r.filled, r.row_count, r.column_count) for r in profile(df).collect()}
    assert cells(spark, tmp_path / "known") == want


def test_parts_with_other_headers(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "d.csv").mkdir(parents=True)
    (folder / "d.csv" / "part-1.csv").write_text('\ufeffa|"b|c"|a|\n1|"x\ny"|2|9\n3|z|4\n')
    (folder / "d.csv" / "part-2.csv").write_text('"b|c"|a\nq|5\n')
    (folder / "bare.csv").write_text("only|header\n")
    (folder / "empty.csv").write_text("")
    cataloguing.update(spark, str(folder), str(tmp_path / "known"))
    assert cells(spark, tmp_path / "known") == {
        ("d.csv", "a"): ("int64", 3, 3, 3), ("d.csv", "b|c"): ("object", 3, 3, 3), ("d.csv", "a.1"): ("float64", 2, 3, 3),
        ("bare.csv", "only"): ("empty", 0, 0, 2), ("bare.csv", "header"): ("empty", 0, 0, 2),
    }


def test_only_changed_files_are_read(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "in", str(tmp_path / "known")
    folder.mkdir()
    for name in "abcd":
        (folder / f"{name}.csv").write_text(f"x|y\n1|{name}\n")
    assert names(cataloguing.update(spark, str(folder), root)[1]) == ["a.csv", "b.csv", "c.csv", "d.csv"]
    opened = []
    listing = cataloguing.list_files

    def watched(spark, path, *args, content=False):
        opened.extend(path if content else [])
        return listing(spark, path, *args, content=content)

    monkeypatch.setattr(cataloguing, "list_files", watched)
    monkeypatch.setattr(cataloguing, "read_records", lambda *a: pytest.fail("records were read"))
    assert cataloguing.update(spark, str(folder), root)[1] == [] and not opened
    os.utime(folder / "a.csv", (1e9, 1e9))  # touched, same content: digested, not read
    assert cataloguing.update(spark, str(folder), root)[1] == [] and names(opened) == ["a.csv"]
    monkeypatch.undo()
    (folder / "b.csv").write_text("x|y\n1.5|b\n2|c\n")
    (folder / "c.csv").unlink()
    (folder / "e.csv").write_text("z\n1\n")
    assert names(cataloguing.update(spark, str(folder), root)[1]) == ["b.csv", "e.csv"]
    assert cells(spark, root) == {
        ("a.csv", "x"): ("int64", 1, 1, 2), ("a.csv", "y"): ("object", 1, 1, 2), ("b.csv", "x"): ("float64", 2, 2, 2),
        ("b.csv", "y"): ("object", 2, 2, 2), ("d.csv", "x"): ("int64", 1, 1, 2), ("d.csv", "y"): ("object", 1, 1, 2),
        ("e.csv", "z"): ("int64", 1, 1, 1),
    }


def test_a_run_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "in", str(tmp_path / "known")
    folder.mkdir()
    (folder / "a.csv").write_text("x\n1\n")
    cataloguing.update(spark, str(folder), root)
    (folder / "b.csv").write_text("x\n1\n")
    monkeypatch.setattr(loading, "publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        cataloguing.update(spark, str(folder), root)
    monkeypatch.undo()
    assert set(cells(spark, root)) == {("a.csv", "x")}
    assert names(cataloguing.update(spark, str(folder), root)[1]) == ["b.csv"]


def test_job_describes_every_dataset(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.csv").write_text("cf|other\n1|q\n2|r\n")
    (folder / "b.csv").write_text("cf\n7\n")
    (folder / "crosswalk.json").write_text(json.dumps({"_crosswalk": {"cf": {"uri": "schema:taxID"}}}))
    os.utime(folder / "a.csv", (1_700_000_000, 1_700_000_000))
    read = jobs.catalogue_job(spark, str(folder), str(tmp_path / "known"), str(out), NOW, publisher="someone")
    assert names(read) == ["a.csv", "b.csv"]
    rows = spark.read.option("basePath", str(out / "datasets")).text(str(out / "datasets")).collect()
    records = {r.file: json.loads(r.value) for r in rows}
    a = records["a.csv"]
    assert a["dcterms:title"] == "a" and a["dcterms:modified"] == "2023-11-14T22:13:20" and a["dcterms:publisher"] == "someone"
    assert a["dcat:distribution"] == {"dcat:accessURL": "a.csv", "dcat:mediaType": "text/csv", "bytes": (folder / "a.csv").stat().st_size}
    assert a["structure"]["unmapped_columns"] == ["other"] and a["structure"]["row_count"] == 2
    assert a["structure"]["columns"][0]["semantic"] == {"uri": "schema:taxID"}
    listed = json.loads(spark.read.text(str(out / "catalogue")).first().value)
    assert listed["dcterms:issued"] == "2024-06-30T12:00:00"
    assert listed["datasets"] == [
        {"title": "a", "file": "a.csv", "row_count": 2, "column_count": 2}, {"title": "b", "file": "b.csv", "row_count": 1, "column_count": 1},
    ]
    assert jobs.catalogue_job(spark, str(folder), str(tmp_path / "known"), str(out), NOW) == []


def test_cells_are_not_turned_into_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "t.csv").write_text("a|b|c\n+1|.5|-\n-2|1.e3|:1\n3|+.5e-1|/\n")
    found = cataloguing.file_columns(spark, [str(folder / "t.csv")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and " at#" in line.split("], [")[0]]
    whole, decimal, text = cataloguing.WHOLE, cataloguing.DECIMAL, cataloguing.TEXT
    assert {(r.column_name, r.kinds, r.filled, r.row_count) for r in found.collect()} == {
        ("a", whole, 3, 3), ("b", decimal, 3, 3), ("c", text, 3, 3)
    }


def test_large_files_are_digested_in_pieces(spark, tmp_path, monkeypatch):
    """No task holds a file that can be read in pieces as one value."""
    folder, root = tmp_path / "in 100%25", str(tmp_path / "known")
    folder.mkdir()
    body = b"x|y\n" + b"1|" + b"a" * (5 << 20) + b"\n"
    given = {"large.csv": body, "packed.csv.gz": gzip.compress(body[:90]), "small.csv": b"x\n1\n"}
    for name, content in given.items():
        (folder / name).write_bytes(content)
    whole, listing = [], cataloguing.list_files

    def watched(spark, path, *args, content=False):
        whole.extend(path if content else [])
        return listing(spark, path, *args, content=content)

    monkeypatch.setattr(cataloguing, "list_files", watched)
    monkeypatch.setattr(cataloguing, "file_columns", lambda spark, *a: spark.createDataFrame([], cataloguing.COLUMNS))
    cataloguing.update(spark, str(folder), root, pattern="*")
    assert names(whole) == ["packed.csv.gz", "small.csv"]
    found = {r.dataset: r.sha256 for r in cataloguing.known(spark, root)["files"].collect()}
    assert found == {name: hashlib.sha256(content).hexdigest() for name, content in given.items()}


def test_each_file_is_digested_by_its_own_task(spark, tmp_path):
    paths = [str(tmp_path / f"{k}.bin") for k in range(6)]
    for k, path in enumerate(paths):
        Path(path).write_bytes(bytes([k]) * k)
    digests = files.stream_digests(spark, [f"file:{path}" for path in paths])
    assert digests.rdd.getNumPartitions() == 6
    assert {r.path: r.sha256 for r in digests.collect()} == {
        f"file:{path}": hashlib.sha256(bytes([k]) * k).hexdigest() for k, path in enumerate(paths)
    }
    (tmp_path / "packed.gz").write_bytes(gzip.compress(b"text"))  # as it is, not unpacked
    packed = files.stream_digests(spark, [f"file://{tmp_path}/packed.gz"]).first()
    assert packed.sha256 == hashlib.sha256((tmp_path / "packed.gz").read_bytes()).hexdigest()
    assert files.stream_digests(spark, []).count() == 0
    assert not files.streamable("nostore://a/b.csv", 3) and not files.streamable(f"file:{tmp_path}/none.csv", 3)
