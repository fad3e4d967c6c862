"""Research projects: filter and link organisations, projects and topics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import config
from ..functions import (
    date_or_null, day_first_date, decimal_comma, programme_label, strip_country_prefix,
    topic_level_1, topic_level_2,
)
from ..operators.dedup import keep_first
from ..operators.joins import keep_matching, look_up
from ..operators.names import join_names, whole_cells
from ..session import settle


@dataclass(frozen=True)
class Programme:
    """Raw tables of one funding programme; ``row_id`` is the place in the file."""

    organization: DataFrame
    project: DataFrame
    topics: DataFrame
    blank_level_falls_back: bool


def vat_dimension(registry: DataFrame, order: list) -> DataFrame:
    """One (piva, cf) per VAT number: the first row wins."""
    return keep_first(registry.select("piva", "cf", *order), ["piva"], order).select("piva", "cf")


# fixed values: roles whose names are listed, and the project column of each list
LISTED_ROLES = {"coordinator": "coordinator", "participant": "participants"}


def name_lists(organization: DataFrame, order: list[str]) -> DataFrame:
    """``;``-joined organisation names per project, a column per listed role, in parts."""
    return join_names(
        organization, "projectID",
        {into: F.when(F.col("role") == role, F.col("name")) for role, into in LISTED_ROLES.items()},
        order,
    )


def with_valid_vat(organization: DataFrame, country: str = "IT") -> DataFrame:
    """Rows of one country with an 11-character VAT number, prefix removed."""
    return (
        organization.filter(F.col("country") == country)
        .filter(~F.col("vatNumber").isin(config.NO_VAT) & (F.col("vatNumber") != ""))
        .withColumn("vatNumber", strip_country_prefix(F.col("vatNumber")))
        .filter(F.length("vatNumber") == config.VAT_DIGITS)
    )


def link_companies(organization: DataFrame, dimension: DataFrame) -> DataFrame:
    """Add the tax code of a known VAT number."""
    return look_up(organization, dimension, "vatNumber", "piva", ["cf"])


def with_comma_amounts(organization: DataFrame) -> DataFrame:
    return organization.withColumns(
        {c: decimal_comma(F.col(c)) for c in ("ecContribution", "netEcContribution")}
    )


def add_names(project: DataFrame, lists: DataFrame) -> DataFrame:
    """Add each whole name list as one cell to projects keyed by ``id``."""
    columns = list(LISTED_ROLES.values())
    return look_up(project, whole_cells(lists, "projectID", columns), "id", "projectID", columns)


def further_names(lists: DataFrame) -> DataFrame:
    """Parts after the first of long lists, once more in rows of bounded size: projectID, part and the lists."""
    return lists.filter("part > 0")


def with_topic_levels(topics: DataFrame, blank_falls_back: bool) -> DataFrame:
    path = F.col("euroSciVocPath")
    return topics.withColumns({
        "livello_1": topic_level_1(path),
        "livello_2": topic_level_2(path, blank_falls_back),
    })


def build_organization(source: Programme, dimension: DataFrame) -> DataFrame:
    """Organisations that count, with the tax code of known companies."""
    return link_companies(with_comma_amounts(with_valid_vat(source.organization)), dimension)


def build_lists(source: Programme, counted: DataFrame, order: list[str]) -> DataFrame:
    """Name lists of the projects that have an organisation that counts."""
    return name_lists(keep_matching(source.organization, counted, "projectID"), order)


def build_project(source: Programme, counted: DataFrame, lists: DataFrame) -> DataFrame:
    """Projects that have an organisation that counts, with all names by role."""
    return add_names(keep_matching(source.project, counted, "id", "projectID"), lists)


def build_topics(source: Programme, counted: DataFrame) -> DataFrame:
    """Topics of the projects that have an organisation that counts."""
    return with_topic_levels(
        keep_matching(source.topics, counted, "projectID"), source.blank_level_falls_back
    )


def counted_projects(source: Programme) -> DataFrame:
    """Distinct projects that have an organisation that counts."""
    return with_valid_vat(source.organization).select("projectID").distinct()


def finish_projects(project: DataFrame) -> DataFrame:
    dated = [c for c in config.PROJECT_DATE_COLUMNS if c in project.columns]
    return (
        project.withColumnRenamed("id", "projectID")
        .withColumn("frameworkProgramme", programme_label(F.col("frameworkProgramme")))
        .withColumns({c: date_or_null(F.col(c)) for c in dated})
    )


def finish_organizations(organization: DataFrame) -> DataFrame:
    if "contentUpdateDate" not in organization.columns:
        return organization
    return organization.withColumn("contentUpdateDate", day_first_date(F.col("contentUpdateDate")))


def together(parts: list[DataFrame]) -> DataFrame:
    """All rows of the programmes; a column one of them lacks is null there."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def run_participation(
    programmes: list[Programme], dimension: DataFrame, order: list[str]
) -> dict[str, DataFrame]:
    """Programmes in; organization, project, topics and further_names out.

    The projects that count are worked out once per programme and written.
    """
    organizations, projects, topics, further = [], [], [], []
    for source in programmes:
        counted = settle(counted_projects(source), "counted")
        lists = build_lists(source, counted, order)
        organizations.append(build_organization(source, dimension))
        projects.append(build_project(source, counted, lists))
        topics.append(build_topics(source, counted))
        further.append(further_names(lists))
    return {
        "organization": finish_organizations(together(organizations)),
        "project": finish_projects(together(projects)),
        "topics": together(topics),
        "further_names": together(further),
    }


def regional_matches(organization: DataFrame, dimension: DataFrame) -> DataFrame:
    """Organisations whose VAT number belongs to a registered company."""
    return keep_matching(organization, dimension, "vatNumber", "piva")
