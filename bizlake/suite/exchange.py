"""Sources and sinks: tables written to files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config
from ..functions import parse_amount
from ..operators.joins import look_up
from ..session import fresh_path, settle
from ..sources import files
from ..sources.crosswalk import parse_crosswalk
from ..sources.delimited import load_table, read_delimited, read_skipping_long_lines
from ..sources.sinks import (
    layout_columns, replace_table, with_decimal_commas, write_delimited, write_json,
)
from ..sources.workbooks import require_sheets, sheet_header, sheet_table, workbook_cells
from .base import Tables, query
from .columns import amount_sql, company_layout
from .samples import as_workbooks, write_archives, write_lines

COMPANY = ["cf", "denominazione", "prov", "comune", "tel"]
TOKENS = ", ".join(f"'{token}'" for token in config.NULL_TOKENS)


def _text(column: str) -> str:
    return f"CASE WHEN {column} NOT IN ({TOKENS}) THEN {column} END AS {column}"


def _written(t: Tables, df: DataFrame, label: str, sep: str, ending: str = "") -> str:
    path = fresh_path(t.spark, label) + ending
    write_delimited(df, path, sep=sep)
    return path


@query("S1_workbook_sheets", "SELECT cf, denominazione, prov, comune, tel FROM comp")
def _(t: Tables):
    books = as_workbooks(t.comp.select(*COMPANY), *config.WORKBOOK_SHEETS)
    cells = require_sheets(settle(workbook_cells(books), "cells"), config.WORKBOOK_SHEETS)
    sheet = config.WORKBOOK_SHEETS[0]
    return sheet_table(cells, sheet, sheet_header(cells, sheet))


@query("S3_pipe_scan", f"SELECT {', '.join(map(_text, COMPANY))} FROM comp")
def _(t: Tables):
    path = _written(t, t.comp.select(*COMPANY), "pipe", "|")
    return read_delimited(t.spark, path, "|")


@query("S4_pipe_scan_keeping_blanks", "SELECT cf, cia, rea, anno, ricavi_delle_vendite FROM fin")
def _(t: Tables):
    fin = t.fin.select("cf", "cia", "rea", "anno", "ricavi_delle_vendite")
    return read_delimited(t.spark, _written(t, fin, "pipe-blank", "|"), "|", blanks="keep")


@query("S5_decimal_comma_scan", f"""
SELECT cf, anno, {amount_sql('ricavi_delle_vendite')} AS amount FROM fin""")
def _(t: Tables):
    fin = t.fin.select("cf", "anno", "ricavi_delle_vendite")
    scan = read_delimited(t.spark, _written(t, fin, "semicolon", ";"), ";", blanks="keep")
    return scan.select("cf", "anno", parse_amount(F.col("ricavi_delle_vendite")).alias("amount"))


@query("S6_semicolon_scan", "SELECT projectID, cf, name, role, ecContribution FROM org")
def _(t: Tables):
    org = t.org.select("projectID", "cf", "name", "role", "ecContribution")
    return read_delimited(t.spark, _written(t, org, "org", ";"), ";")


@query("S6_documents_with_line_breaks", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents""")
def _(t: Tables):
    docs = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    return read_delimited(t.spark, _written(t, docs, "docs", ";"), ";", blanks="keep")


@query("S7_skip_long_lines", """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type,
       CASE WHEN event_id % 7 = 3 THEN NULL ELSE props END AS props
FROM events WHERE event_id % 5 <> 2""")
def _(t: Tables):
    """Every fifth line has a field too many, every seventh one too few."""
    quoted = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(
        ";", F.col("event_id").cast("string"), "event_type",
        F.when((F.col("event_id") % 7 != 3) | (F.col("event_id") % 5 == 2), quoted),
        F.when(F.col("event_id") % 5 == 2, F.lit("too;many")),
    )
    path = fresh_path(t.spark, "lines")
    write_lines(t.events.select(line.alias("value")), "event_id;event_type;props", path)
    return read_skipping_long_lines(t.spark, path)


@query("S8_load_by_ending", "SELECT cf, denominazione, comune FROM comp")
def _(t: Tables):
    comp = t.comp.select("cf", "denominazione", "comune")
    return load_table(t.spark, _written(t, comp, "comp", ";", ".csv"))


MONTHLY = r"imprese_home_(\d{2})_(\d{4})\.xlsx"


@query("S9_latest_month", """
SELECT 'imprese_home_' || strftime(max(o_orderdate), '%m_%Y') || '.xlsx' AS name,
       strftime(max(o_orderdate), '%m_%Y') AS snapshot
FROM orders WHERE o_orderdate < TIMESTAMP '1999-07-01'""")
def _(t: Tables):
    names = t.orders.select(
        F.format_string("imprese_home_%s.xlsx", F.date_format("o_orderdate", "MM_yyyy")).alias("name")
    )
    return files.latest_monthly(names, MONTHLY, 1999, 6)


@query("S10_latest_year", """
SELECT 'statements_' || CAST(max(year(o_orderdate)) AS VARCHAR) || '.csv' AS name,
       CAST(max(year(o_orderdate)) AS INT) AS year
FROM orders WHERE year(o_orderdate) <= 1999""")
def _(t: Tables):
    names = t.orders.select(
        F.format_string("statements_%d.csv", F.year("o_orderdate")).alias("name")
    )
    return files.latest_yearly(names, r"statements_(\d{4})\.csv", 1999)


@query("S11_latest_modified", """
SELECT name, strftime(modified, '%Y-%m-%d %H:%M:%S') AS modified FROM
 (SELECT 'file_' || CAST(o_orderkey AS VARCHAR) AS name, o_orderdate AS modified FROM orders)
ORDER BY 2 DESC, 1 DESC LIMIT 1""")
def _(t: Tables):
    named = t.orders.select(
        F.concat(F.lit("file_"), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_orderdate").alias("modified"),
    )
    best = files.latest_modified(named)
    return best.select("name", F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified"))


@query("S12_list_datasets", "SELECT DISTINCT 'anno=' || CAST(year(o_orderdate) AS VARCHAR) AS dataset FROM orders")
def _(t: Tables):
    path = fresh_path(t.spark, "datasets")
    dated = t.orders.select("o_orderkey", F.year("o_orderdate").alias("anno"))
    dated.write.partitionBy("anno").option("header", True).csv(path)
    found = files.list_files(t.spark, path, "*.csv")
    return found.select(F.element_at(F.split("path", "/"), -2).alias("dataset")).distinct()


@query("S13_archive_members", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
def _(t: Tables):
    folder, target = fresh_path(t.spark, "archives"), fresh_path(t.spark, "unpacked")
    write_archives(t.documents.select("doc_id", "text"), folder)
    members = files.archive_members(files.list_files(t.spark, folder, "*.zip"))
    unpacked = files.unpack_members(files.wanted_members(members), target)
    unpacked.write.format("noop").mode("overwrite").save()
    return read_delimited(t.spark, f"{target}/*/csv/*.csv", ";", blanks="keep")


@query("S14_layout_sink", "SELECT denominazione, cf, coalesce(tel, '') AS tel FROM comp")
def _(t: Tables):
    path = fresh_path(t.spark, "layout")
    columns = layout_columns(company_layout(t), "nomi_colonne_corretti", "ordine_portale")
    write_delimited(t.comp, path, columns)
    return read_delimited(t.spark, path, "|", blanks="keep")


@query("S15_decimal_comma_sink", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
       replace(CAST(o_totalprice AS VARCHAR), '.', ',') AS o_totalprice FROM orders""")
def _(t: Tables):
    path = fresh_path(t.spark, "commas")
    rows = t.orders.select(F.col("o_orderkey").cast("string"), "o_totalprice")
    write_delimited(with_decimal_commas(rows), path)
    return read_delimited(t.spark, path, "|", blanks="keep")


@query("S16_full_refresh", "SELECT cf, denominazione FROM comp WHERE prov <> 'NA'")
def _(t: Tables):
    """The second load replaces the first."""
    name = "bizlake_companies"
    comp = t.comp.select("cf", "denominazione", "prov")
    t.spark.sql(f"drop table if exists {name}")
    path = fresh_path(t.spark, "companies")
    replace_table(comp, name, path)
    replace_table(comp.filter("prov <> 'NA'").drop("prov"), name, path)
    return t.spark.read.parquet(path)


@query("S17_json_if_absent", "SELECT cf, denominazione FROM comp")
def _(t: Tables):
    """The second write finds the target and leaves it alone."""
    path = fresh_path(t.spark, "json")
    comp = t.comp.select("cf", "denominazione")
    write_json(comp, path, if_absent=True)
    write_json(comp.filter("cf = '1'"), path, if_absent=True)
    return t.spark.read.schema(comp.schema).json(path)


@query("S18_crosswalk", """
SELECT column_name, uri, note, count(*) AS n_rows FROM
 (SELECT event_type AS column_name, 'schema:' || event_type AS uri, CAST(user_id AS VARCHAR) AS note
  FROM events WHERE event_id % 10 <> 0) GROUP BY ALL""")
def _(t: Tables):
    """One crosswalk document per event; every tenth is broken."""
    meaning = F.struct(
        F.concat(F.lit("schema:"), "event_type").alias("uri"),
        F.col("user_id").cast("string").alias("note"),
    )
    text = F.to_json(F.struct(F.create_map("event_type", meaning).alias("_crosswalk")))
    broken = F.when(F.col("event_id") % 10 == 0, F.lit("{not json")).otherwise(text)
    walk = parse_crosswalk(t.events.select(broken.alias("value")))
    return walk.groupBy("column_name", "semantic.uri", "semantic.note").agg(
        F.count("*").alias("n_rows")
    )


@query("F23_map_lookup", """
SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN 'schema:' || event_type END AS uri
FROM events""")
def _(t: Tables):
    """Meanings of the known event types, looked up by a join on the name."""
    known = t.events.filter("event_type <> 'error'").select(
        F.col("event_type").alias("column_name"),
        F.concat(F.lit("schema:"), "event_type").alias("uri"),
    ).distinct()
    return look_up(
        t.events.select("event_id", "event_type"), known, "event_type", "column_name", ["uri"]
    )
