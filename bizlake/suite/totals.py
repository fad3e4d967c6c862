"""Aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import date_or_null, parse_amount, repair_shifted_year
from ..operators.aggregates import count_by_flag, distinct_by_case, distinct_per_group, frequencies
from ..operators.bitmaps import add_load, distinct_counts
from ..operators.joins import look_up
from ..operators.names import join_names, whole_cells
from ..operators.shares import top_rows, widths_of_shown
from ..plans import dashboards, registry
from .base import Tables, query
from .bindings import LINE_ORDER, LINE_ORDER_SQL
from .columns import REPAIRED, amount_sql


@query("A1_pivot_count_with_margins", """
SELECT cf, count(*) FILTER (sede_ul = 'SEDE') AS s, count(*) FILTER (sede_ul <> 'SEDE') AS u,
       count(*) AS "All" FROM reg GROUP BY cf
UNION ALL SELECT 'All', count(*) FILTER (sede_ul = 'SEDE'), count(*) FILTER (sede_ul <> 'SEDE'), count(*)
FROM reg""")
def _(t: Tables):
    flagged = t.reg.select("cf", registry.site_flag().alias("flag"))
    return count_by_flag(flagged, "cf", "flag", ["s", "u"], "All")


@query("A2_joined_names", f"""
SELECT projectID, CAST(0 AS BIGINT) AS part, string_agg(name, ';' ORDER BY {LINE_ORDER_SQL}) AS participants
FROM org_raw WHERE role = 'participant' GROUP BY projectID""")
def _(t: Tables):
    chosen = t.org_raw.filter("role = 'participant'")
    parts = join_names(chosen, "projectID", {"participants": F.col("name")}, LINE_ORDER)
    return whole_cells(parts, "projectID", ["participants"])


@query("A3_top_frequencies", """
SELECT euroSciVocPath, n, CAST(row_number() OVER (ORDER BY n DESC, euroSciVocPath) AS BIGINT) AS rank
FROM (SELECT euroSciVocPath, count(*) AS n FROM voc WHERE euroSciVocPath IS NOT NULL GROUP BY 1)
ORDER BY n DESC, euroSciVocPath LIMIT 5""")
def _(t: Tables):
    counted = frequencies(t.voc, "euroSciVocPath")
    return top_rows(counted, [F.desc("n"), F.asc("euroSciVocPath")], 5)


@query("A4_distinct_count", """
SELECT CAST(count(DISTINCT vatNumber) AS BIGINT) AS vats, CAST(count(DISTINCT projectID) AS BIGINT) AS projects
FROM org_raw""")
def _(t: Tables):
    return t.org_raw.agg(
        F.count_distinct("vatNumber").alias("vats"), F.count_distinct("projectID").alias("projects")
    )


@query("A6_grouped_distinct_count", """
SELECT tipo_impresa, prov, CAST(count(DISTINCT cf) AS BIGINT) AS company_count
FROM sites GROUP BY tipo_impresa, prov""")
def _(t: Tables):
    return distinct_per_group(t.sites, ["tipo_impresa", "prov"], "cf", "company_count")


@query("A6_counts_over_two_loads", """
SELECT tipo_impresa, prov, CAST(count(DISTINCT cf) AS BIGINT) AS company_count
FROM sites GROUP BY tipo_impresa, prov""")
def _(t: Tables):
    """Active sites are the first load, the others come later and are added."""
    groups = ["tipo_impresa", "prov"]
    active = F.col("stato_impresa") == "ATTIVA"
    first = add_load(t.sites.filter(active), groups, "cf")
    return distinct_counts(add_load(t.sites.filter(~active), groups, "cf", first), groups, "company_count")


@query("A4_counts_rolled_up", """
SELECT anno, CAST(count(DISTINCT cf) AS BIGINT) AS company_count FROM fin GROUP BY anno
UNION ALL SELECT 'all', count(DISTINCT cf) FROM fin""")
def _(t: Tables):
    """A year is added to the years before; the total comes from the same bitmaps."""
    late = F.col("anno") > "1996"
    years = add_load(t.fin.filter(late), ["anno"], "cf", add_load(t.fin.filter(~late), ["anno"], "cf"))
    total = distinct_counts(years, [], "company_count").select(F.lit("all").alias("anno"), "company_count")
    return distinct_counts(years, ["anno"], "company_count").unionByName(total)


@query("A7_amount_sums", f"""
SELECT cf, anno, round(sum({amount_sql('ricavi_delle_vendite')}), 2) AS revenue FROM fin GROUP BY cf, anno""")
def _(t: Tables):
    amount = parse_amount(F.col("ricavi_delle_vendite"))
    return t.fin.groupBy("cf", "anno").agg(F.round(F.sum(amount), 2).alias("revenue"))


LINKED = """
SELECT org.cf, org.projectID, substr(startDate, 1, 4) AS year, frameworkProgramme, ecContribution
FROM org JOIN proj ON org.projectID = proj.projectID
WHERE org.cf IS NOT NULL AND frameworkProgramme IN ('H2020','HORIZON EUROPE')"""


@query("A8_companies_by_year_and_programme", f"""
SELECT year, CAST(count(DISTINCT cf) FILTER (frameworkProgramme = 'H2020') AS BIGINT) AS h2020_count,
       CAST(count(DISTINCT cf) FILTER (frameworkProgramme = 'HORIZON EUROPE') AS BIGINT) AS he_count
FROM ({LINKED}) WHERE year <> '' GROUP BY year""")
def _(t: Tables):
    return dashboards.companies_per_start_year(t.org, t.proj).select("year", "h2020_count", "he_count")


A9 = f"""
SELECT cf, round(sum(CASE WHEN frameworkProgramme = 'H2020' THEN a ELSE 0 END), 2) AS h2020_amount,
       round(sum(CASE WHEN frameworkProgramme <> 'H2020' THEN a ELSE 0 END), 2) AS he_amount,
       round(sum(a), 2) AS total_amount
FROM (SELECT *, {amount_sql('ecContribution')} AS a FROM ({LINKED})) GROUP BY cf"""


@query("A9_contribution_by_company", A9)
def _(t: Tables):
    return dashboards.contribution_by_company(t.org, t.proj)


A10 = """
SELECT title, CAST(count(DISTINCT projectID) FILTER (frameworkProgramme = 'H2020') AS BIGINT) AS h2020_count,
       CAST(count(DISTINCT projectID) FILTER (frameworkProgramme = 'HORIZON EUROPE') AS BIGINT) AS he_count,
       CAST(count(DISTINCT projectID) AS BIGINT) AS total_count
FROM (SELECT voc.projectID, coalesce(nullif(euroSciVocTitle, ''), 'Non classificato') AS title,
             frameworkProgramme FROM voc JOIN proj ON voc.projectID = proj.projectID
      WHERE frameworkProgramme IN ('H2020','HORIZON EUROPE')) GROUP BY title"""


@query("A10_projects_by_topic", A10)
def _(t: Tables):
    return dashboards.topic_counts(t.voc, t.proj)


@query("A11_rows_per_company", """
SELECT comp.cf, coalesce(f.n, 0) AS financial_count, coalesce(o.n, 0) AS project_count,
       f.last AS latest_financial_year
FROM comp LEFT JOIN (SELECT cf, count(*) AS n, max(anno) AS last FROM fin GROUP BY cf) f ON f.cf = comp.cf
LEFT JOIN (SELECT cf, count(*) AS n FROM org WHERE cf IS NOT NULL GROUP BY cf) o ON o.cf = comp.cf""")
def _(t: Tables):
    return dashboards.connected_counts(t.comp, t.fin, t.org)


DATES = {c: f"CAST({REPAIRED.format(c)} AS DATE)" for c in ("data_isc_ri", "data_cost", "data_canc")}


@query("A12_row_wise_min_max", f"""
SELECT cf, sede_ul, rea, CAST(least({', '.join(DATES.values())}) AS VARCHAR) AS first_day,
       CAST(greatest({', '.join(DATES.values())}) AS VARCHAR) AS last_day FROM reg""")
def _(t: Tables):
    days = [date_or_null(repair_shifted_year(F.col(c))) for c in DATES]
    return t.reg.select(
        "cf", "sede_ul", "rea", F.least(*days).cast("string").alias("first_day"),
        F.greatest(*days).cast("string").alias("last_day"),
    )


@query("A13_largest_of_shown", """
SELECT anno, n, max(n) OVER () AS largest FROM
  (SELECT anno, count(*) AS n FROM fin GROUP BY anno)""")
def _(t: Tables):
    counted = frequencies(t.fin, "anno")
    return counted.withColumn("largest", counted.select(F.max("n")).scalar())


@query("A14_distinct_sorted", "SELECT DISTINCT anno FROM fin WHERE anno <> '' ORDER BY anno")
def _(t: Tables):
    return dashboards.available_years(t.fin)


@query("A15_companies_without_hq", """
SELECT cf FROM reg GROUP BY cf HAVING count(*) FILTER (sede_ul = 'SEDE') = 0""")
def _(t: Tables):
    return registry.companies_without_headquarters(t.reg)
