"""Questions asked of the serving tables.  Parameters in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import config
from ..functions import contains_ignoring_case, label_or, parse_amount, year_text
from ..operators.aggregates import distinct_by_case, distinct_per_group, first_nonblank
from ..operators.dedup import rank_within
from ..operators.joins import join_by, keep_matching, look_up
from ..operators.order import number_in_group
from ..operators.shares import add_widths, shares_of_shown, top_rows, widths_of_shown
from ..session import settle

H2020, HORIZON_EUROPE = config.PROGRAMMES


def active_rows(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("stato_impresa") == config.ACTIVE)


# --- companies ----------------------------------------------------------------
def company_totals(registry: DataFrame) -> DataFrame:
    """Active companies and active sites."""
    return active_rows(registry).agg(
        F.count_distinct("cf").alias("active_companies"), F.count("*").alias("active_sites")
    )


def legal_forms(registry: DataFrame) -> DataFrame:
    """The most frequent legal forms of active companies, with their shares."""
    counted = distinct_per_group(
        active_rows(registry).filter("tipo_impresa != ''"), ["tipo_impresa"], "cf", "company_count"
    )
    shown = top_rows(
        counted, [F.desc("company_count"), F.asc("tipo_impresa")], config.LEGAL_FORMS_SHOWN
    )
    return shares_of_shown(shown, "company_count")


def province_counts(registry: DataFrame, province: str | None = None) -> DataFrame:
    """Active companies per home province; an unknown province means all of them."""
    chosen = [province] if province in config.HOME_PROVINCES else config.HOME_PROVINCES
    counted = distinct_per_group(
        active_rows(registry).filter(F.col("prov").isin(chosen)), ["prov"], "cf", "company_count"
    )
    shown = top_rows(counted, [F.desc("company_count"), F.asc("prov")], len(config.HOME_PROVINCES))
    return widths_of_shown(shown, {"company_count": "bar_width"})


def company_names(
    companies: DataFrame, headquarters: DataFrame, registry: DataFrame, order: list[str]
) -> DataFrame:
    """cf and company_name for a short list of companies that have headquarters."""
    wanted = keep_matching(headquarters.select("cf"), companies, "cf")
    rows = keep_matching(registry.select("cf", "denominazione", *order), F.broadcast(wanted), "cf")
    return first_nonblank(rows, "cf", {"denominazione": "company_name"}, order)


def with_company_names(
    shown: DataFrame, headquarters: DataFrame, registry: DataFrame, order: list[str]
) -> DataFrame:
    """Add the company name to a short report, falling back to the tax code.

    The report is written first: its few rows are used twice.
    """
    shown = settle(shown, "shown")
    names = company_names(shown, headquarters, registry, order)
    return look_up(shown, names, "cf", "cf", ["company_name"]).withColumn(
        "company_name", label_or(F.col("company_name"), F.col("cf"))
    )


def first_children(
    children: DataFrame, order: list[Column | str], key: str = "cf", n: int = config.CHILDREN_SHOWN
) -> DataFrame:
    """The first rows of every parent, ranked."""
    return rank_within(children, [key], order, n, "place")


def nested_children(ranked: DataFrame, columns: list[str], into: str, key: str = "cf") -> DataFrame:
    """Ranked children as one ordered array per parent; the rank bounds its length."""
    entry = F.struct("place", *columns)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias(into))


def company_detail(
    headquarters: DataFrame, registry: DataFrame, financial: DataFrame, organization: DataFrame,
    project: DataFrame, order: list[str], cf: str | None = None, shown: int | None = None,
) -> dict[str, DataFrame]:
    """Companies with their registry rows, statements and projects.

    ``cf`` asks for one company; without it the answer covers every company.
    ``shown`` keeps the first registry rows and statements only.  Children are
    flat rows with their ``place`` under the company.
    """
    company = headquarters if cf is None else headquarters.filter(F.col("cf") == cf)

    def own(df: DataFrame) -> DataFrame:
        return keep_matching(df, company, "cf")

    def placed(df: DataFrame, by: list[Column | str]) -> DataFrame:
        if shown is None:
            return number_in_group(df, ["cf"], by, "place")
        return first_children(df, by, n=shown)

    acronyms = project.select("projectID", F.col("acronym").alias("project_acronym"))
    linked = join_by(own(organization), acronyms, ["projectID"])
    return {
        "company": company,
        "registry": placed(own(registry), order),
        "financial": placed(own(financial), [F.desc("anno"), "rea"]),
        "projects": number_in_group(
            linked, ["cf"], ["projectID", "organisationID", *order], "place", sizes=organization
        ),
    }


def company_search(
    headquarters: DataFrame, registry: DataFrame, financial: DataFrame, organization: DataFrame,
    query: str = "", row_id: list[str] = ("row_id",),
) -> DataFrame:
    """Companies by tax code or name, with registry, statement and project rows counted."""
    counts = connected_counts(headquarters, financial, organization)
    sites = registry.groupBy("cf").agg(F.count("*").alias("filtered_count"))
    listed = look_up(counts, sites, "cf", "cf", ["filtered_count"]).na.fill(0, ["filtered_count"])
    fields = {c: into for c, into in REGISTRY_FIELDS.items()}
    found = matching_companies(listed, registry, query, ["denominazione"])
    return look_up(
        found, first_nonblank(registry, "cf", fields, list(row_id)), "cf", "cf",
        list(fields.values()),
    )


# --- projects -----------------------------------------------------------------
def of_programmes(project: DataFrame) -> DataFrame:
    return project.filter(F.col("frameworkProgramme").isin(config.PROGRAMMES))


def with_project(facts: DataFrame, project: DataFrame, columns: list[str]) -> DataFrame:
    """Facts of the two programmes with columns of their project."""
    return join_by(facts, of_programmes(project).select("projectID", *columns), ["projectID"])


def _by_programme() -> dict[str, Column]:
    programme = F.col("frameworkProgramme")
    return {"h2020_count": programme == H2020, "he_count": programme == HORIZON_EUROPE}


BOTH_COUNTS = {"h2020_count": "h2020_width", "he_count": "he_width"}


def companies_per_start_year(organization: DataFrame, project: DataFrame) -> DataFrame:
    """Distinct companies by start year and programme, with bar widths."""
    linked = with_project(
        organization.filter(F.col("cf").isNotNull()).select("projectID", "cf"),
        project, ["frameworkProgramme", "startDate"],
    ).withColumn("year", year_text(F.col("startDate")))
    counted = distinct_by_case(linked.filter("year != ''"), ["year"], "cf", _by_programme())
    return add_widths(counted, BOTH_COUNTS)


def contribution_by_company(organization: DataFrame, project: DataFrame) -> DataFrame:
    """Contribution per company and programme, and in total."""
    linked = with_project(
        organization.filter(F.col("cf").isNotNull()).select("projectID", "cf", "ecContribution"),
        project, ["frameworkProgramme"],
    ).withColumn("amount", parse_amount(F.col("ecContribution")))
    cases = {"h2020_amount": H2020, "he_amount": HORIZON_EUROPE}
    summed = linked.groupBy("cf").agg(*[
        F.sum(F.when(F.col("frameworkProgramme") == p, F.col("amount")).otherwise(0.0)).alias(c)
        for c, p in cases.items()
    ])
    return summed.withColumn(
        "total_amount", F.round(F.col("h2020_amount") + F.col("he_amount"), 2)
    ).withColumns({c: F.round(c, 2) for c in cases})


def top_contributions(
    organization: DataFrame, project: DataFrame, headquarters: DataFrame, registry: DataFrame,
    order: list[str],
) -> DataFrame:
    """The companies with the highest contributions."""
    shown = top_rows(
        contribution_by_company(organization, project),
        [F.desc("total_amount"), F.asc("cf")], config.RANKING_SHOWN,
    )
    scaled = widths_of_shown(shown, {"h2020_amount": "h2020_width", "he_amount": "he_width"})
    return with_company_names(scaled, headquarters, registry, order)


def topic_counts(topics: DataFrame, project: DataFrame) -> DataFrame:
    """Distinct projects by topic and programme, and in total."""
    titled = topics.select(
        "projectID",
        label_or(F.col("euroSciVocTitle"), config.UNCLASSIFIED_TOPIC).alias("title"),
    )
    linked = with_project(titled, project, ["frameworkProgramme"])
    counted = distinct_by_case(linked, ["title"], "projectID", _by_programme())
    return counted.withColumn("total_count", F.col("h2020_count") + F.col("he_count"))


def top_topics(topics: DataFrame, project: DataFrame) -> DataFrame:
    """The topics with the most projects."""
    shown = top_rows(
        topic_counts(topics, project), [F.desc("total_count"), F.asc("title")],
        config.RANKING_SHOWN,
    )
    return widths_of_shown(shown, BOTH_COUNTS)


def project_detail(
    project: DataFrame, organization: DataFrame, topics: DataFrame, order: list[str],
    project_id: str | None = None,
) -> dict[str, DataFrame]:
    """Projects with their organisations and topics as flat rows in display order.

    ``project_id`` asks for one project; without it the answer covers all.
    """
    chosen = project if project_id is None else project.filter(F.col("projectID") == project_id)
    members = keep_matching(organization, chosen, "projectID")
    themes = keep_matching(topics, chosen, "projectID")
    return {
        "project": chosen,
        "organization": project_children(members, ["organisationID", *order], organization),
        "topics": project_children(themes, ["livello_1", "livello_2", *order], topics),
    }


def project_children(children: DataFrame, order: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Children of all projects, numbered in display order within their project.

    ``sizes`` are the same children before they were joined, if they were.
    """
    return number_in_group(children, ["projectID"], order, "place", sizes=sizes)


def project_search(
    project: DataFrame, organization: DataFrame, topics: DataFrame, query: str = ""
) -> DataFrame:
    """Projects by id, acronym or title with organisations, companies and topics counted."""
    found = project
    if query:
        hit = [contains_ignoring_case(F.col(c), query) for c in ("projectID", "acronym", "title")]
        found = project.filter(hit[0] | hit[1] | hit[2])
    members = organization.groupBy("projectID").agg(F.count("*").alias("organization_count"))
    companies = distinct_per_group(organization, ["projectID"], "cf", "company_count")
    themes = topics.groupBy("projectID").agg(F.count("*").alias("topic_count"))
    listed = found.select("projectID", "acronym", "status")
    for counts, name in (
        (members, "organization_count"), (companies, "company_count"), (themes, "topic_count")
    ):
        listed = look_up(listed, counts, "projectID", "projectID", [name])
    return listed.na.fill(0, ["organization_count", "company_count", "topic_count"])


# --- connected companies --------------------------------------------------------
REGISTRY_FIELDS = {
    "denominazione": "company_name",
    "comune": "registry_comune",
    "stato_impresa": "registry_stato_impresa",
}


def connected_counts(
    headquarters: DataFrame, financial: DataFrame, organization: DataFrame
) -> DataFrame:
    """Statements, participations and latest year per company.

    Each child is counted on its own, so the join to the company never fans out.
    """
    statements = financial.groupBy("cf").agg(
        F.count("*").alias("financial_count"), F.max("anno").alias("latest_financial_year")
    )
    members = (
        organization.filter(F.col("cf").isNotNull())
        .groupBy("cf").agg(F.count("*").alias("project_count"))
    )
    listed = look_up(
        headquarters.select("cf"), statements, "cf", "cf",
        ["financial_count", "latest_financial_year"],
    )
    listed = look_up(listed, members, "cf", "cf", ["project_count"])
    return listed.na.fill(0, ["financial_count", "project_count"])


def matching_companies(
    companies: DataFrame, registry: DataFrame, query: str, columns: list[str]
) -> DataFrame:
    """Companies whose tax code, or any of whose registry rows, contains the query."""
    if not query:
        return companies
    hits = [contains_ignoring_case(F.col(c), query) for c in columns]
    any_hit = hits[0]
    for hit in hits[1:]:
        any_hit = any_hit | hit
    by_row = registry.filter(any_hit).groupBy("cf").agg(F.lit(True).alias("_hit"))
    joined = look_up(companies, by_row, "cf", "cf", ["_hit"])
    own = contains_ignoring_case(F.col("cf"), query)
    return joined.filter(own | F.col("_hit").isNotNull()).drop("_hit")


def connected_companies(
    headquarters: DataFrame, registry: DataFrame, financial: DataFrame, organization: DataFrame,
    query: str = "", order: list[str] = ("row_id",), shown: int = config.COMPANIES_SHOWN,
) -> DataFrame:
    """Companies with statements or projects, most projects first."""
    connected = connected_counts(headquarters, financial, organization).filter(
        "financial_count > 0 or project_count > 0"
    )
    found = matching_companies(connected, registry, query.strip(), ["denominazione", "comune"])
    order_shown = [F.desc("project_count"), F.desc("financial_count"), F.asc("cf")]
    ranked = settle(top_rows(found, order_shown, shown), "shown")
    rows = keep_matching(registry, F.broadcast(ranked.select("cf")), "cf")
    fields = first_nonblank(rows, "cf", REGISTRY_FIELDS, list(order))
    return look_up(ranked, fields, "cf", "cf", list(REGISTRY_FIELDS.values()))


# --- finance --------------------------------------------------------------------
def with_year(financial: DataFrame) -> DataFrame:
    return financial.filter("anno != ''")


def available_years(financial: DataFrame) -> DataFrame:
    return with_year(financial).select("anno").distinct().orderBy("anno")


def companies_per_year(financial: DataFrame) -> DataFrame:
    """Distinct companies per statement year."""
    counted = distinct_per_group(with_year(financial), ["anno"], "cf", "company_count")
    return add_widths(counted, {"company_count": "bar_width"})


def revenue_per_year(financial: DataFrame) -> DataFrame:
    """Sales per statement year."""
    summed = with_year(financial).groupBy("anno").agg(
        F.round(F.sum(parse_amount(F.col("ricavi_delle_vendite"))), 2).alias("revenue")
    )
    return add_widths(summed, {"revenue": "bar_width"})


def revenue_ranking(
    financial: DataFrame, headquarters: DataFrame, registry: DataFrame, order: list[str],
    year: str | None = None,
) -> DataFrame:
    """The companies with the highest sales of one year, by default the latest."""
    chosen = F.lit(year) if year else with_year(financial).select(F.max("anno")).scalar()
    summed = financial.filter(F.col("anno") == chosen).groupBy("cf").agg(
        F.round(F.sum(parse_amount(F.col("ricavi_delle_vendite"))), 2).alias("revenue")
    )
    shown = top_rows(summed, [F.desc("revenue"), F.asc("cf")], config.RANKING_SHOWN)
    scaled = widths_of_shown(shown, {"revenue": "bar_width"})
    return with_company_names(scaled, headquarters, registry, order)
