"""Files of every kind, written to a temporary folder."""

import datetime as dt
import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from bizlake.sources import crosswalk, delimited, files, sinks, workbooks
from bizlake.suite import samples
from bizlake.suite.samples import workbook_bytes


def test_scan_turns_missing_words_into_null_and_numbers_rows(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('\ufeffcf|prov|note\n001|NA|"two\nlines"\n002||""\n', encoding="utf-8")
    df = delimited.read_delimited(spark, str(path), "|", row_number="row_id")
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [
        ("001", None, "two\nlines", 1), ("002", None, None, 2),
    ]
    kept = delimited.read_delimited(spark, str(path), "|", blanks="keep")
    assert sorted(tuple(r) for r in kept.collect()) == [("001", "NA", "two\nlines"), ("002", "", "")]


def test_file_order_over_several_splits(spark, tmp_path):
    for name, start in (("a", 0), ("b", 1_000)):
        lines = "\n".join(str(start + i) for i in range(1_000))
        (tmp_path / f"{name}.csv").write_text("n\n" + lines + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        df = delimited.read_delimited(
            spark, str(tmp_path), ";", row_number="row_id", multi_line=False
        )
        assert df.count() == 2_000
        assert df.filter(F.col("row_id") != F.col("n").cast("long") + 1).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_long_records_are_skipped_and_short_ones_kept(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text(
        'id;a;b\n1;x;y\n2;x\n3;x;y;z\n4;"p;q";y\n5;"line\nbreak";y\n6;"say ""hi""";y\n7\n8;x;y;\n'
    )
    df = delimited.read_skipping_long_lines(spark, str(path), row_number="row_id")
    assert [tuple(r) for r in df.orderBy("row_id").select("id", "a", "b").collect()] == [
        ("1", "x", "y"), ("2", "x", None), ("4", "p;q", "y"), ("5", "line\nbreak", "y"),
        ("6", 'say "hi"', "y"), ("7", None, None),
    ]


def test_guards(spark):
    df = spark.createDataFrame([("1",)], "cf string")
    assert delimited.require_columns(df, ["cf"]) is df
    with pytest.raises(delimited.MissingColumnsError):
        delimited.require_columns(df, ["cf", "piva"])
    with pytest.raises(delimited.ColumnCountError):
        delimited.require_column_count(df, 21)
    with pytest.raises(ValueError, match="unsupported"):
        delimited.load_table(spark, "table.ods")


def test_workbook_text_blanks_and_sheet_guard(spark, tmp_path):
    path = tmp_path / "w.xlsx"
    path.write_bytes(workbook_bytes({
        "one": [["cf", "prov"], ["001", "NA"], ["002", ""]], "two": [["x"], ["1"]],
    }))
    cells = workbooks.workbook_cells(workbooks.open_workbooks(spark, str(path)))
    workbooks.require_sheets(cells, ["one", "two"])
    with pytest.raises(ValueError, match="expected sheets"):
        workbooks.require_sheets(cells, ["one"])
    table = workbooks.sheet_table(cells, "one", workbooks.sheet_header(cells, "one"), "row_id")
    assert sorted(tuple(r) for r in table.collect()) == [("001", "NA", 1), ("002", "", 2)]
    assert delimited.load_table(spark, str(path)).columns in (["cf", "prov"], ["x"])


def test_workbook_shared_text_dates_and_gaps(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    path = tmp_path / "d.xlsx"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>'
                      '<sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels",
                      '<R><r Id="r1" Target="/xl/worksheets/sheet1.xml"/></R>')
        book.writestr("xl/sharedStrings.xml",
                      f'<sst xmlns="{main}"><si><t>day</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/>'
                      '<xf numFmtId="14"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>'
                      '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
                      '<row r="2"><c r="A2" s="1"><v>31837</v></c><c r="C2" t="b"><v>1</v></c></row>'
                      '</sheetData></worksheet>')
    cells = workbooks.workbook_cells(workbooks.open_workbooks(spark, str(path)))
    assert sorted((r.row, r.cells) for r in cells.collect()) == [
        (1, ["day", "", "rich"]), (2, ["1987-03-01 00:00:00", "", "True"]),
    ]


def test_snapshots(spark):
    pattern = r"imprese_home_(\d{2})_(\d{4})\.xlsx"

    def latest(names, year, month):
        df = spark.createDataFrame([(n,) for n in names], "name string")
        row = files.latest_monthly(df, pattern, year, month).first()
        return row and row.snapshot

    found = ["imprese_home_12_2023.xlsx", "imprese_home_02_2024.xlsx", "imprese_home_09_2024.xlsx", "x"]
    assert latest(found, 2024, 5) == "02_2024"
    assert latest(found, 2020, 1) == "09_2024"
    assert latest(["x"], 2024, 5) is None
    years = spark.createDataFrame([("s_2022.csv",), ("s_2024.csv",), ("s_2026.csv",)], "name string")
    assert files.latest_yearly(years, r"s_(\d{4})\.csv", 2025).first().year == 2024
    assert files.latest_yearly(years, r"s_(\d{4})\.csv", 2000).first() is None


def test_manifest_and_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "h.zip", "w") as archive:
        archive.writestr("csv/project.csv", "id;a\n1;x\n")
        archive.writestr("csv/euroSciVoc.csv", "id\n1\n")
        archive.writestr("csv/webItem.csv", "id\n1\n")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    listed = files.list_files(spark, str(tmp_path), "*.zip")
    manifest = {r.name: r for r in files.file_manifest(spark, str(tmp_path), "*.zip").collect()}
    content = (tmp_path / "h.zip").read_bytes()
    assert manifest["h.zip"].sha256 == hashlib.sha256(content).hexdigest()
    assert manifest["h.zip"].md5 == hashlib.md5(content).hexdigest()
    assert files.latest_modified(listed).count() == 1
    members = files.archive_members(listed)
    assert members.filter("member is null").count() == 1
    unpacked = files.unpack_members(files.wanted_members(members), str(tmp_path / "out"))
    assert sorted(r.member for r in unpacked.collect()) == ["csv/euroSciVoc.csv", "csv/project.csv"]
    assert (tmp_path / "out/h/csv/project.csv").read_text() == "id;a\n1;x\n"


def test_archives_of_one_name_are_kept_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        with zipfile.ZipFile(tmp_path / folder / "h.zip", "w") as archive:
            archive.writestr("csv/project.csv", folder)
    paths = spark.createDataFrame([(str(tmp_path / folder / "h.zip"),) for folder in ("a", "b")], "path string")
    unpacked = files.unpack_members(files.archive_members(paths), str(tmp_path / "out")).collect()
    assert len({r.unpacked for r in unpacked}) == 2
    assert sorted(p.read_text() for p in (tmp_path / "out").glob("*/csv/project.csv")) == ["a", "b"]


def test_crosswalk_files(spark, tmp_path):
    flat = tmp_path / "flat.json"
    flat.write_text(json.dumps({"_crosswalk": {"rea": {"uri": "u:rea", "type": "string"}}}))
    nested = tmp_path / "nested.json"
    nested.write_text(json.dumps({"_crosswalk": {"project": {"id": {"uri": "u:id"}}}}))
    (tmp_path / "bad.json").write_text("{not json")
    walk = crosswalk.load_crosswalk(spark, str(flat)).collect()
    assert [(r.column_name, r.semantic.uri) for r in walk] == [("rea", "u:rea")]
    walk = crosswalk.load_crosswalk(spark, str(nested), "project").collect()
    assert [(r.column_name, r.semantic.uri) for r in walk] == [("id", "u:id")]
    assert crosswalk.load_crosswalk(spark, str(nested), "topics").count() == 0
    assert crosswalk.load_crosswalk(spark, str(tmp_path / "bad.json")).count() == 0
    assert crosswalk.load_crosswalk(spark, str(tmp_path / "absent.json")).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [("a|b", 12.5, dt.date(2024, 1, 2), " x ")], "t string, n double, d date, s string"
    )
    path = str(tmp_path / "out")
    sinks.write_delimited(sinks.with_decimal_commas(df), path, ["d", "n", "t", "s"])
    back = delimited.read_delimited(spark, path, "|", blanks="keep")
    assert [tuple(r) for r in back.collect()] == [("2024-01-02", "12,5", "a|b", " x ")]
    layout = spark.createDataFrame(
        [("b", 2.0), ("a", 1.0), ("c", None)], "names string, at double"
    )
    assert sinks.layout_columns(layout, "names", "at") == ["a", "b"]
    target = str(tmp_path / "j")
    sinks.write_json(df.select("t"), target, if_absent=True)
    sinks.write_json(df.select("t").limit(0), target, if_absent=True)
    assert spark.read.json(target).count() == 1


def test_many_small_files_lie_in_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(samples, "FILES_IN_FOLDER", 40)
    texts = [(k, f"page {k}") for k in range(100)] + [(7, "again"), (200, None), (None, "x")]
    samples.write_files(spark.createDataFrame(texts, "page_id long, value string").coalesce(1), "page_id", str(tmp_path))
    found = {r.name: r for r in files.file_manifest(spark, str(tmp_path), "*.txt").collect()}
    assert len(found) == 102 and found["page_id=7.txt"].size_bytes == len("page 7\nagain\n")
    assert found["page_id=200.txt"].size_bytes == 1 and "page_id=__HIVE_DEFAULT_PARTITION__.txt" in found
    assert found["page_id=3.txt"].md5 == hashlib.md5(b"page 3\n").hexdigest()
    assert len({r.path.rsplit("/", 1)[0] for r in found.values()}) <= 3


def test_archives_write_numbers_of_a_batch_alike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(samples, "ROWS_AT_A_TIME", 1)
    samples.write_archives(spark.createDataFrame([(1, "a"), (None, "b")], "doc_id long, text string").coalesce(1), str(tmp_path))
    with zipfile.ZipFile(tmp_path / "000000-000000.zip") as archive:
        assert archive.read("csv/Project.csv") == b"doc_id;text\n1.0;a\n;b\n"


def test_archives_are_written_a_few_rows_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(samples, "ROWS_AT_A_TIME", 3)
    rows = [(k, None if k == 4 else f'text; "{k}"\nline') for k in range(10)]
    for _ in range(2):  # a repeated task replaces its archives
        samples.write_archives(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "z"))
    archives = sorted(p.name for p in (tmp_path / "z").glob("*.zip"))
    assert archives == ["000000-000000.zip", "broken.zip"]
    with zipfile.ZipFile(tmp_path / "z" / archives[0]) as archive:
        assert archive.namelist() == ["csv/Project.csv", "csv/webLink.csv"]
        want = "doc_id;text\n" + "".join(f"{k};" + ("" if t is None else '"' + t.replace('"', '""') + '"') + "\n" for k, t in rows)
        assert archive.read("csv/Project.csv").decode() == want
