"""Describing tables and files: profiles, meanings, manifests, catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed value: how a true or false value is written
TRUE_FALSE = r"^(True|False|true|false)$"


def inferred_type(filled: Column, rows: Column, whole: Column, decimal: Column, logical: Column) -> Column:
    """Type name from counts: rows, filled cells and cells of each kind."""
    return (
        F.when(filled == 0, F.lit("empty"))
        .when(whole == filled, F.when(filled == rows, F.lit("int64")).otherwise(F.lit("float64")))
        .when(decimal == filled, F.lit("float64"))
        .when((logical == filled) & (filled == rows), F.lit("bool"))
        .otherwise(F.lit("object"))
    )


def profile(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per column: position, name, dtype, filled cells, rows, number of columns.

    The whole table is read once.  The type is the narrowest all filled cells
    convert to.  ``by`` profiles groups of rows, such as sheets, apart.
    """
    columns = [c for c in df.columns if c not in by]
    entries = []
    for at, name in enumerate(columns, 1):
        text = F.col(f"`{name}`").cast("string")
        decimal = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
        entries.append(F.struct(
            F.lit(at).cast("bigint").alias("position"),
            F.lit(name).alias("column_name"),
            F.count(text).alias("filled"),
            F.count_if(text.rlike(r"^[+-]?\d+$")).alias("whole"),
            F.count_if(decimal).alias("decimal"),
            F.count_if(text.rlike(TRUE_FALSE)).alias("logical"),
        ))
    counted = df.groupBy(*by).agg(F.count("*").alias("row_count"), F.array(*entries).alias("e"))
    rows = counted.select(*by, "row_count", F.inline("e"))
    kind = inferred_type(
        F.col("filled"), F.col("row_count"), F.col("whole"), F.col("decimal"), F.col("logical")
    )
    return rows.select(
        *by, "position", "column_name", kind.alias("dtype"), "filled", "row_count",
        F.lit(len(columns)).cast("bigint").alias("column_count"),
    )


def annotate(profiled: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Add what each column means; null where the crosswalk has no entry."""
    return profiled.join(crosswalk, "column_name", "left")


def unmapped_columns(annotated: DataFrame) -> DataFrame:
    """Columns without a meaning."""
    return annotated.filter("semantic is null").select("position", "column_name")


def structure(annotated: DataFrame, by: list[str] = ()) -> DataFrame:
    """Columns with type and meaning, counts and unmapped columns, as one row, or one per dataset."""
    column = F.struct("position", F.col("column_name").alias("name"), "dtype", "semantic")
    unmapped = F.when(F.col("semantic").isNull(), F.struct("position", "column_name"))
    packed = annotated.groupBy(*by).agg(
        F.array_sort(F.collect_list(column)).alias("columns"),
        F.any_value("column_count").alias("column_count"),
        F.any_value("row_count").alias("row_count"),
        F.transform(F.array_sort(F.collect_list(unmapped)), lambda u: u["column_name"])
        .alias("unmapped_columns"),
    )
    return packed


def dataset_record(
    described: DataFrame,
    title: str | Column,
    description: str | Column,
    file_name: str | Column,
    media_type: str = "text/csv",
    keywords: list[str] = (),
    publisher: str | None = None,
    sources: list[str] = (),
    provenance: dict[str, str] | None = None,
    size_bytes: int | Column | None = None,
    issued: str | Column | None = None,
    modified: str | Column | None = None,
) -> DataFrame:
    """A description as one JSON text for each row of ``described``, from :func:`structure`.

    What differs between the rows is given as columns of ``described``.
    """
    steps = [x for kv in (provenance or {}).items() for x in map(F.lit, kv)]
    text = "string"
    record = F.struct(
        F.struct(
            F.lit("http://www.w3.org/ns/dcat#").alias("dcat"),
            F.lit("http://purl.org/dc/terms/").alias("dcterms"),
            F.lit("http://www.w3.org/ns/prov#").alias("prov"),
        ).alias("@context"),
        F.lit("dcat:Dataset").alias("@type"),
        F.lit(title).alias("dcterms:title"),
        F.lit(description).alias("dcterms:description"),
        F.array(*map(F.lit, keywords)).cast("array<string>").alias("dcat:keyword"),
        F.lit(publisher).cast(text).alias("dcterms:publisher"),
        F.lit(issued).cast(text).alias("dcterms:issued"),
        F.lit(modified).cast(text).alias("dcterms:modified"),
        F.struct(
            F.lit(file_name).alias("dcat:accessURL"), F.lit(media_type).alias("dcat:mediaType"),
            F.lit(size_bytes).cast("bigint").alias("bytes"),
        ).alias("dcat:distribution"),
        F.struct("columns", "column_count", "row_count", "unmapped_columns").alias("structure"),
        F.array(*map(F.lit, sources)).cast("array<string>").alias("prov:wasDerivedFrom"),
        (F.create_map(*steps) if steps else F.lit(None).cast("map<string,string>"))
        .alias("provenance"),
    )
    return described.select(
        F.lit(title).alias("title"), F.lit(file_name).alias("file"), F.to_json(record).alias("record")
    )


def table_size(df: DataFrame, title: str, file_name: str) -> DataFrame:
    """One catalogue line: title, file, row_count, column_count."""
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(title).alias("title"), F.lit(file_name).alias("file"), "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
    )


def catalogue(tables: dict[str, DataFrame], ending: str = ".csv") -> DataFrame:
    """Catalogue lines of many tables; pass only those not described before, if wanted."""
    lines = [table_size(df, name, name + ending) for name, df in tables.items()]
    merged = lines[0]
    for line in lines[1:]:
        merged = merged.unionByName(line)
    return merged


def catalogue_record(lines: DataFrame, issued: str | None = None) -> DataFrame:
    """Catalogue lines as one JSON text with its date of issue; there is one line per dataset."""
    entry = F.struct("title", "file", "row_count", "column_count")
    listed = lines.agg(F.array_sort(F.collect_list(entry)).alias("datasets"))
    context = F.struct(
        F.lit("http://www.w3.org/ns/dcat#").alias("dcat"),
        F.lit("http://purl.org/dc/terms/").alias("dcterms"),
    )
    record = F.struct(
        context.alias("@context"), F.lit("dcat:Catalog").alias("@type"),
        F.lit(issued).cast("string").alias("dcterms:issued"), F.col("datasets"),
    )
    return listed.select(F.to_json(record).alias("record"))


def sheet_profile(cells: DataFrame) -> DataFrame:
    """Sheets of many workbooks: sheet, rows below the headers, columns.

    Workbooks with another header for the same sheet give another row.
    """
    books = cells.groupBy("path", "sheet").agg(
        F.max(F.when(F.col("row") == 1, F.filter("cells", lambda c: c != ""))).alias("header"),
        F.count_if(F.col("row") > 1).alias("n"),
    )
    return books.groupBy("sheet", "header").agg(F.sum("n").alias("row_count")).select(
        "sheet", "row_count", F.size("header").cast("bigint").alias("column_count"),
        F.array_join("header", ";").alias("columns"),
    )
