"""The flows from files to files: find the input, run, write the results."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config
from ..session import settle
from ..sources import files
from ..sources.crosswalk import load_crosswalk
from ..sources.delimited import read_delimited, read_skipping_long_lines
from ..sources.sinks import with_decimal_commas, write_delimited
from ..sources.workbooks import read_workbook
from . import catalogue, cataloguing, financial, participation, registry, serving
from .loading import Load, missing_path

# fixed values: how snapshot files are named
MONTHLY_WORKBOOK = r"imprese_[a-z]+_(\d{2})_(\d{4})\.xlsx"
YEARLY_STATEMENTS = r"[a-z]+_(\d{4})\.csv"

ROW = "row_id"


def _chosen(found: DataFrame, folder: str):
    row = found.first()
    if row is None:
        raise FileNotFoundError(f"no snapshot file in {folder}")
    return row


def registry_job(
    spark: SparkSession,
    folder: str,
    target: str,
    today: dt.date,
    renames: dict[str, dict[str, str]] | None = None,
    layouts: dict[str, list[str]] | None = None,
    strict: bool = False,
) -> list[str]:
    """Latest monthly workbook in, eight delimited exports out; returns their paths.

    ``renames`` maps file names to column names per sheet, ``layouts`` gives
    the ordered columns per export; without one, company columns come first.
    """
    listed = files.list_files(spark, folder, "*.xlsx")
    found = _chosen(files.latest_monthly(listed, MONTHLY_WORKBOOK, today.year, today.month), folder)
    sheets = read_workbook(spark, found.path, config.WORKBOOK_SHEETS, ROW)
    sites, codes = (
        sheets[s].withColumnsRenamed((renames or {}).get(s, {})) for s in config.WORKBOOK_SHEETS
    )
    exports = registry.run_registry(sites, codes.drop(ROW), found.snapshot, today, strict)
    written = []
    for name, df in exports.items():
        known = config.ACTIVITY_COLUMNS if "activities" in name else config.COMPANY_COLUMNS
        first = [c for c in known if c in df.columns]
        rest = [c for c in df.columns if c not in first and c != ROW]
        write_delimited(df, f"{target}/{name}.csv", (layouts or {}).get(name, first + rest))
        written.append(f"{target}/{name}.csv")
    return written


def read_programme(spark: SparkSession, folder: str, blank_falls_back: bool) -> participation.Programme:
    """The three raw files of one funding programme."""
    return participation.Programme(
        organization=read_delimited(spark, f"{folder}/organization.csv", ";", row_number=ROW),
        project=read_skipping_long_lines(spark, f"{folder}/project.csv"),
        topics=read_skipping_long_lines(spark, f"{folder}/euroSciVoc.csv"),
        blank_level_falls_back=blank_falls_back,
    )


def participation_job(
    spark: SparkSession, first: str, second: str, registry_path: str, target: str
) -> None:
    """Folders of the two programmes and the filtered registry in, three tables out.

    Projects hold whole name lists; parts after the first are also in ``further_names``.
    """
    companies = read_delimited(spark, registry_path, "|", row_number=ROW)
    programmes = [read_programme(spark, first, False), read_programme(spark, second, True)]
    out = participation.run_participation(
        programmes, participation.vat_dimension(companies, [ROW]), [ROW]
    )
    for name, df in out.items():
        write_delimited(df.drop(ROW), f"{target}/{name}.csv")


def _previous(spark: SparkSession, path: str) -> DataFrame | None:
    names = {name: column for column, name in config.FINANCIAL_FILE_NAMES.items()}
    try:
        return read_delimited(spark, path, "|", blanks="keep").withColumnsRenamed(names)
    except AnalysisException as error:
        if missing_path(error):
            return None
        raise  # an earlier output that can't be read must not be replaced


def financial_job(spark: SparkSession, folder: str, target: str, year: int) -> None:
    """Latest yearly statements in, ``financial.csv`` and ``financial_errors.csv`` out.

    The earlier output is read before it is replaced: the new one is written
    to the shared folder first.
    """
    listed = files.list_files(spark, folder, "*.csv")
    found = _chosen(files.latest_yearly(listed, YEARLY_STATEMENTS, year), folder)
    raw = read_delimited(spark, found.path, ";", blanks="keep", row_number=ROW)
    path = f"{target}/financial.csv"
    out = financial.run_financial(raw, _previous(spark, path))
    names = [config.FINANCIAL_FILE_NAMES[c] for c in config.FINANCIAL_COLUMNS]
    valid = settle(out["valid"].select(*config.FINANCIAL_COLUMNS), "valid")
    write_delimited(with_decimal_commas(valid).toDF(*names), path)
    write_delimited(out["errors"], f"{target}/financial_errors.csv")


def serving_job(spark: SparkSession, sources: dict[str, str], root: str) -> Load:
    """Paths of the six exports in; the serving tables loaded under ``root`` and published.

    Keys: headquarters, registry, financial, project, organization, topics.
    Readers ask :func:`loading.published_tables`; until the last step, and after
    any error, they get the load before.
    """
    tables = {
        name: read_delimited(spark, path, "|", blanks="keep", row_number=ROW)
        for name, path in sources.items()
    }
    names = {name: column for column, name in config.FINANCIAL_FILE_NAMES.items()}
    tables["financial"] = tables["financial"].withColumnsRenamed(names)
    load = serving.load_serving(tables, root, ROW)
    load.check("headquarters", "project")
    load.publish()
    return load


def catalogue_job(
    spark: SparkSession, folder: str, root: str, target: str, now: dt.datetime, crosswalk: str | None = None,
    sep: str = "|", keywords: list[str] = (), publisher: str | None = None, provenance: dict[str, str] | None = None,
) -> list[str]:
    """Describe every dataset of a folder; returns the files that were read.

    ``target/datasets/file=...`` gets one JSON text per dataset, ``target/catalogue``
    the list of all.  What is known is kept under ``root``: a second run reads only
    files that are new or changed.  ``crosswalk`` is the path of the columns' meanings.
    """
    _, read = cataloguing.update(spark, folder, root, sep)
    meanings = load_crosswalk(spark, crosswalk or f"{folder}/crosswalk.json")
    described = settle(cataloguing.describe(cataloguing.known(spark, root), meanings), "described")
    issued = now.isoformat(timespec="seconds")
    records = catalogue.dataset_record(
        described, F.col("title"), F.concat(F.lit("Dataset "), F.col("file")), F.col("file"), keywords=keywords, publisher=publisher,
        provenance={"generated_on": issued, **(provenance or {})},
        size_bytes=F.col("size_bytes"), issued=F.col("issued"), modified=F.col("modified"),
    )
    records.select("file", "record").write.mode("overwrite").partitionBy("file").text(f"{target}/datasets")
    catalogue.catalogue_record(described, issued).write.mode("overwrite").text(f"{target}/catalogue")
    return read
