"""Profiles, meanings, manifests and catalogue lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..plans import catalogue, cataloguing
from ..session import fresh_path
from ..sources import files
from ..sources.sinks import write_delimited
from ..sources.workbooks import workbook_cells
from .base import TABLES, Tables, query
from .samples import as_workbooks, write_files


def _profile_sql(table: str, columns: list[str], by: str = "") -> str:
    """Profile of every column of a table in SQL."""
    parts = []
    for at, column in enumerate(columns, 1):
        text = f"CAST({column} AS VARCHAR)"
        number = rf"regexp_matches({text}, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')"
        parts.append(f"""
SELECT {by + ',' if by else ''} CAST({at} AS BIGINT) AS position, '{column}' AS column_name,
 CASE WHEN count({column}) = 0 THEN 'empty'
  WHEN count(*) FILTER (regexp_matches({text}, '^[+-]?[0-9]+$')) = count({column})
   THEN CASE WHEN count({column}) = count(*) THEN 'int64' ELSE 'float64' END
  WHEN count(*) FILTER ({number}) = count({column}) THEN 'float64'
  WHEN count(*) FILTER (lower({text}) IN ('true', 'false')) = count(*) THEN 'bool'
  ELSE 'object' END AS dtype,
 count({column}) AS filled, count(*) AS row_count, CAST({len(columns)} AS BIGINT) AS column_count
FROM {table} {'GROUP BY ' + by if by else ''}""")
    return " UNION ALL ".join(parts)


ORGANIZATION = ["projectID", "cf", "organisationID", "name", "role", "ecContribution", "vatNumber"]


@query("M1_table_profile", _profile_sql("org", ORGANIZATION))
def _(t: Tables):
    return catalogue.profile(t.org.select(*ORGANIZATION))


LINES = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@query("M1_lineitem_profile", _profile_sql("lineitem", LINES))
def _(t: Tables):
    return catalogue.profile(t.lineitem.select(*LINES))


@query("M2_profile_per_sheet", """
SELECT 'FRIULI Anagrafica' AS sheet, count(*) AS row_count, CAST(3 AS BIGINT) AS column_count,
       'cf;denominazione;prov' AS columns FROM comp
UNION ALL SELECT 'FRIULI codice attività', count(*), 2, 'cf;denominazione' FROM comp""")
def _(t: Tables):
    books = as_workbooks(t.comp.select("cf", "denominazione", "prov"), *config.WORKBOOK_SHEETS)
    return catalogue.sheet_profile(workbook_cells(books))


CROSSWALK = """
SELECT 'projectID' AS column_name, 'schema:identifier' AS uri UNION ALL SELECT 'cf', 'schema:taxID'
UNION ALL SELECT 'name', 'schema:name'"""


def _crosswalk(t: Tables):
    rows = [("projectID", "schema:identifier"), ("cf", "schema:taxID"), ("name", "schema:name")]
    return t.spark.createDataFrame(rows, "column_name string, uri string").select(
        "column_name", F.struct("uri").alias("semantic")
    )


@query("M3_annotated_profile", f"""
SELECT position, p.column_name, dtype, row_count, uri
FROM ({_profile_sql('org', ORGANIZATION)}) p LEFT JOIN ({CROSSWALK}) c ON c.column_name = p.column_name""")
def _(t: Tables):
    described = catalogue.annotate(catalogue.profile(t.org.select(*ORGANIZATION)), _crosswalk(t))
    return described.select("position", "column_name", "dtype", "row_count", "semantic.uri")


@query("M3_unmapped_columns", f"""
SELECT position, column_name FROM ({_profile_sql('org', ORGANIZATION)})
WHERE column_name NOT IN (SELECT column_name FROM ({CROSSWALK}))""")
def _(t: Tables):
    described = catalogue.annotate(catalogue.profile(t.org.select(*ORGANIZATION)), _crosswalk(t))
    return catalogue.unmapped_columns(described)


@query("M4_file_manifest", """
SELECT CAST(page_id AS VARCHAR) AS page_id, CAST(strlen(html) + 1 AS BIGINT) AS size_bytes,
       sha256(html || chr(10)) AS sha256, md5(html || chr(10)) AS md5 FROM pages""")
def _(t: Tables):
    """Every page written to a file of its own: size and digests of each file."""
    path = fresh_path(t.spark, "manifest")
    pages = t.pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("html").alias("value"))
    write_files(pages, "page_id", path)
    page = F.regexp_extract("path", r"page_id=([^/]+)\.txt$", 1)
    return files.file_manifest(t.spark, path, "*.txt").select(page.alias("page_id"), "size_bytes", "sha256", "md5")


@query("M5_dataset_record", f"""
WITH p AS ({_profile_sql('org', ORGANIZATION)})
SELECT 'organization' AS title, 'organization.csv' AS file, any_value(column_count) AS column_count,
       any_value(row_count) AS row_count,
       string_agg(column_name || ':' || dtype, ';' ORDER BY position) AS columns,
       string_agg(column_name, ';' ORDER BY position) FILTER
         (column_name NOT IN (SELECT column_name FROM ({CROSSWALK}))) AS unmapped,
       'dcat:Dataset' AS kind FROM p""")
def _(t: Tables):
    described = catalogue.annotate(catalogue.profile(t.org.select(*ORGANIZATION)), _crosswalk(t))
    record = catalogue.dataset_record(
        catalogue.structure(described), "organization", "Participating organisations",
        "organization.csv", keywords=["projects"], sources=["lineitem"],
        provenance={"generated_by": "participation"},
    )
    shape = (
        "struct<columns:array<struct<name:string,dtype:string>>,column_count:bigint,"
        "row_count:bigint,unmapped_columns:array<string>>"
    )
    read = record.select(
        "title", "file", F.from_json("record", f"`@type` string, structure {shape}").alias("r")
    )
    return read.select(
        "title", "file", "r.structure.column_count", "r.structure.row_count",
        F.array_join(
            F.transform("r.structure.columns", lambda c: F.concat_ws(":", c["name"], c["dtype"])), ";"
        ).alias("columns"),
        F.array_join("r.structure.unmapped_columns", ";").alias("unmapped"),
        F.col("r.@type").alias("kind"),
    )


@query("M6_catalogue", " UNION ALL ".join(
    f"SELECT '{name}' AS title, '{name}.csv' AS file, count(*) AS row_count, "
    f"(SELECT count(*) FROM (DESCRIBE {name})) AS column_count FROM {name}" for name in TABLES))
def _(t: Tables):
    return catalogue.catalogue({name: getattr(t, name) for name in TABLES})


@query("M6_catalogue_record", """
WITH c AS (""" + " UNION ALL ".join(
    f"SELECT '{name}' AS title, count(*) AS row_count FROM {name}" for name in TABLES) + """)
SELECT string_agg(title || ':' || CAST(row_count AS VARCHAR), ';' ORDER BY title) AS datasets FROM c""")
def _(t: Tables):
    record = catalogue.catalogue_record(catalogue.catalogue({name: getattr(t, name) for name in TABLES}))
    shape = "datasets array<struct<title:string,row_count:bigint>>"
    read = record.select(F.from_json("record", shape).alias("r"))
    return read.select(F.array_join(
        F.transform("r.datasets", lambda d: F.concat_ws(":", d["title"], d["row_count"])), ";"
    ).alias("datasets"))


@query("A5_written_row_counts", """
SELECT 'comp' AS title, 'comp.csv' AS file, count(*) AS row_count, CAST(2 AS BIGINT) AS column_count
FROM comp""")
def _(t: Tables):
    """Rows of a written export, counted as records."""
    path = fresh_path(t.spark, "counted")
    write_delimited(t.comp.select("cf", "denominazione"), path)
    written = t.spark.read.option("sep", "|").option("header", True).csv(path)
    return catalogue.table_size(written, "comp", "comp.csv")


#: Tables exported to one folder, and the columns of each.
EXPORTED = {
    "org": ORGANIZATION, "comp": ["cf", "denominazione", "prov", "comune", "tel"],
    "fin": ["cf", "cia", "rea", "anno", "ricavi_delle_vendite"],
}


def _as_text(table: str) -> str:
    """A table as it reads from a file: blank cells are missing."""
    cells = ", ".join(f"nullif(CAST({c} AS VARCHAR), '') AS {c}" for c in EXPORTED[table])
    return f"(SELECT {cells} FROM {table}) AS x"


def _exported(t: Tables, *tables: str) -> str:
    folder = fresh_path(t.spark, "exports")
    for table in tables:
        write_delimited(getattr(t, table).select(*EXPORTED[table]), f"{folder}/{table}.csv")
    return folder


@query("M1_folder_profile", " UNION ALL ".join(
    f"SELECT '{name}.csv' AS file, * FROM ({_profile_sql(_as_text(name), columns)})" for name, columns in EXPORTED.items()))
def _(t: Tables):
    """Columns and types of all exports of a folder, in one pass over their cells."""
    folder, root = _exported(t, *EXPORTED), fresh_path(t.spark, "known")
    cataloguing.update(t.spark, folder, root)
    return cataloguing.dataset_columns(cataloguing.known(t.spark, root))


@query("M6_folder_catalogue", " UNION ALL ".join(
    f"""SELECT '{name}' AS title, '{name}.csv' AS file, count(*) AS row_count,
 CAST({len(columns)} AS BIGINT) AS column_count, 'true' AS sized,
 '{";".join(c for c in columns if c not in ("projectID", "cf", "name"))}' AS unmapped FROM {name}"""
    for name, columns in EXPORTED.items()))
def _(t: Tables):
    """One description per dataset of a folder, with the facts of its files."""
    folder, root = _exported(t, *EXPORTED), fresh_path(t.spark, "known")
    cataloguing.update(t.spark, folder, root)
    described = cataloguing.describe(cataloguing.known(t.spark, root), _crosswalk(t))
    record = catalogue.dataset_record(
        described, F.col("title"), F.col("file"), F.col("file"), size_bytes=F.col("size_bytes"), issued=F.col("issued"), modified=F.col("modified"),
    )
    shape = (
        "`dcterms:issued` string, `dcterms:modified` string, `dcat:distribution` struct<bytes:bigint>, "
        "structure struct<row_count:bigint,column_count:bigint,unmapped_columns:array<string>>"
    )
    read = record.select("title", "file", F.from_json("record", shape).alias("r"))
    sized = (F.col("r.dcat:distribution.bytes") > 0) & (F.col("r.dcterms:issued") <= F.col("r.dcterms:modified"))
    return read.select(
        "title", "file", "r.structure.row_count", "r.structure.column_count", sized.cast("string").alias("sized"),
        F.array_join("r.structure.unmapped_columns", ";").alias("unmapped"),
    )


@query("S12_changed_files", """
SELECT 'fin.csv' AS dataset, count(*) AS row_count FROM fin""")
def _(t: Tables):
    """Rows read by the second look at a folder to which one export was added."""
    folder, root = _exported(t, "org", "comp"), fresh_path(t.spark, "known")
    cataloguing.update(t.spark, folder, root)
    write_delimited(t.fin.select(*EXPORTED["fin"]), f"{folder}/fin.csv")
    _, read = cataloguing.update(t.spark, folder, root)
    tables = cataloguing.known(t.spark, root)
    opened = t.spark.createDataFrame([(path,) for path in read], "path string")
    rows = tables["columns"].join(opened, "path").groupBy("path").agg(F.max("row_count").alias("n"))
    return rows.join(tables["files"], "path").groupBy("dataset").agg(F.sum("n").alias("row_count"))
