"""The questions users ask: company, project and finance reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..plans import dashboards, participation
from .base import Tables, query
from .bindings import LINE_ORDER, LINE_ORDER_SQL
from .columns import amount_sql
from .totals import A9, A10, LINKED

NAMES = f"""
SELECT cf, denominazione AS company_name FROM
 (SELECT cf, denominazione, row_number() OVER (PARTITION BY cf ORDER BY {LINE_ORDER_SQL}) AS rn
  FROM sites WHERE denominazione <> '' AND cf IN (SELECT cf FROM comp)) WHERE rn = 1"""


@query("Q1_company_totals", """
SELECT CAST(count(DISTINCT cf) AS BIGINT) AS active_companies, count(*) AS active_sites
FROM sites WHERE stato_impresa = 'ATTIVA'""")
def _(t: Tables):
    return dashboards.company_totals(t.sites)


@query("Q1_legal_forms", """
WITH top AS (SELECT tipo_impresa, company_count,
    CAST(row_number() OVER (ORDER BY company_count DESC, tipo_impresa) AS BIGINT) AS rank
  FROM (SELECT tipo_impresa, CAST(count(DISTINCT cf) AS BIGINT) AS company_count FROM sites
        WHERE stato_impresa = 'ATTIVA' AND tipo_impresa <> '' GROUP BY 1)
  ORDER BY company_count DESC, tipo_impresa LIMIT 6),
 s AS (SELECT *, round(company_count / sum(company_count) OVER () * 100, 1) AS pct_of_shown FROM top)
SELECT *, round(sum(pct_of_shown) OVER (ORDER BY rank), 1) AS slice_end,
       round(sum(pct_of_shown) OVER (ORDER BY rank) - pct_of_shown, 1) AS slice_start FROM s""")
def _(t: Tables):
    return dashboards.legal_forms(t.sites)


@query("Q1_provinces", """
SELECT *, round(company_count / max(company_count) OVER () * 100, 1) AS bar_width,
       CAST(row_number() OVER (ORDER BY company_count DESC, prov) AS BIGINT) AS rank
FROM (SELECT prov, CAST(count(DISTINCT cf) AS BIGINT) AS company_count FROM sites
      WHERE stato_impresa = 'ATTIVA' AND prov IN ('GO','PN','UD','TS') GROUP BY prov)""")
def _(t: Tables):
    return dashboards.province_counts(t.sites)


@query("Q1_one_province", """
SELECT prov, CAST(count(DISTINCT cf) AS BIGINT) AS company_count, 100.0::DOUBLE AS bar_width,
       CAST(1 AS BIGINT) AS rank
FROM sites WHERE stato_impresa = 'ATTIVA' AND prov = 'UD' GROUP BY prov""")
def _(t: Tables):
    return dashboards.province_counts(t.sites, "UD")


@query("Q2_company_detail", f"""
SELECT cf, 'registry' AS section, CAST(place AS BIGINT) AS place, comune || '|' || stato_impresa AS shown
FROM (SELECT *, row_number() OVER (PARTITION BY cf ORDER BY {LINE_ORDER_SQL}) AS place FROM sites)
WHERE place <= 10 AND cf IN (SELECT cf FROM comp)
UNION ALL
SELECT cf, 'financial', CAST(place AS BIGINT), anno || '|' || totale_attivo
FROM (SELECT *, row_number() OVER (PARTITION BY cf ORDER BY anno DESC, rea) AS place FROM fin)
WHERE place <= 10 AND cf IN (SELECT cf FROM comp)
UNION ALL
SELECT cf, 'project', CAST(row_number() OVER (PARTITION BY cf ORDER BY org.projectID, organisationID,
       {LINE_ORDER_SQL}) AS BIGINT), acronym || '|' || name || '|' || role
FROM org JOIN proj ON org.projectID = proj.projectID WHERE cf IN (SELECT cf FROM comp)""")
def _(t: Tables):
    found = dashboards.company_detail(t.comp, t.sites, t.fin, t.org, t.proj, LINE_ORDER, shown=config.CHILDREN_SHOWN)

    def section(key: str, name: str, *columns: str):
        return found[key].select(
            "cf", F.lit(name).alias("section"), F.col("place").cast("bigint").alias("place"),
            F.concat_ws("|", *columns).alias("shown"),
        )

    return (
        section("registry", "registry", "comune", "stato_impresa")
        .unionByName(section("financial", "financial", "anno", "totale_attivo"))
        .unionByName(section("projects", "project", "project_acronym", "name", "role"))
    )


YEARS = f"""
SELECT year, CAST(count(DISTINCT cf) FILTER (frameworkProgramme = 'H2020') AS BIGINT) AS h2020_count,
       CAST(count(DISTINCT cf) FILTER (frameworkProgramme = 'HORIZON EUROPE') AS BIGINT) AS he_count
FROM ({LINKED}) WHERE year <> '' GROUP BY year"""


def _both_widths(a: str, b: str) -> str:
    largest = f"max(greatest({a}, {b})) OVER ()"
    return (f"round({a} / {largest} * 100, 1) AS h2020_width, "
            f"round({b} / {largest} * 100, 1) AS he_width")


@query("Q3_companies_per_year",
       f"SELECT *, {_both_widths('h2020_count', 'he_count')} FROM ({YEARS})")
def _(t: Tables):
    return dashboards.companies_per_start_year(t.org, t.proj)


@query("Q3_top_contributions", f"""
WITH top AS (SELECT *, CAST(row_number() OVER (ORDER BY total_amount DESC, cf) AS BIGINT) AS rank
             FROM ({A9}) ORDER BY total_amount DESC, cf LIMIT 20),
     names AS ({NAMES})
SELECT top.*, {_both_widths('h2020_amount', 'he_amount')},
       coalesce(company_name, top.cf) AS company_name
FROM top LEFT JOIN names ON names.cf = top.cf""")
def _(t: Tables):
    return dashboards.top_contributions(t.org, t.proj, t.comp, t.sites, LINE_ORDER)


@query("Q3_top_topics", f"""
SELECT *, {_both_widths('h2020_count', 'he_count')} FROM
 (SELECT *, CAST(row_number() OVER (ORDER BY total_count DESC, title) AS BIGINT) AS rank FROM ({A10})
  ORDER BY total_count DESC, title LIMIT 20)""")
def _(t: Tables):
    return dashboards.top_topics(t.voc, t.proj)


LEVELS = """
SELECT *, string_split(euroSciVocPath, '/')[2] AS livello_1,
       coalesce(string_split(euroSciVocPath, '/')[3], string_split(euroSciVocPath, '/')[2]) AS livello_2
FROM voc"""


@query("Q4_project_detail", f"""
SELECT org.projectID, 'organisation' AS section, CAST(row_number() OVER (PARTITION BY org.projectID
       ORDER BY organisationID, {LINE_ORDER_SQL}) AS BIGINT) AS place, name || '|' || role AS shown
FROM org JOIN proj ON org.projectID = proj.projectID
UNION ALL
SELECT v.projectID, 'topic', CAST(row_number() OVER (PARTITION BY v.projectID
       ORDER BY livello_1 NULLS FIRST, livello_2 NULLS FIRST, {LINE_ORDER_SQL}) AS BIGINT),
       concat_ws('|', livello_1, livello_2)
FROM ({LEVELS}) v JOIN proj ON v.projectID = proj.projectID""")
def _(t: Tables):
    topics = participation.with_topic_levels(t.voc, blank_falls_back=False)
    found = dashboards.project_detail(t.proj, t.org, topics, LINE_ORDER)

    def section(key: str, name: str, *columns: str):
        return found[key].select(
            "projectID", F.lit(name).alias("section"), "place",
            F.concat_ws("|", *columns).alias("shown"),
        )

    return section("organization", "organisation", "name", "role").unionByName(
        section("topics", "topic", "livello_1", "livello_2")
    )


def connected_sql(match: str) -> str:
    def first(column: str) -> str:
        return (f"SELECT cf, {column} AS v, row_number() OVER (PARTITION BY cf ORDER BY "
                f"{LINE_ORDER_SQL}) AS rn FROM sites WHERE {column} <> ''")

    return f"""
WITH f AS (SELECT cf, count(*) AS n, max(anno) AS last FROM fin GROUP BY cf),
     o AS (SELECT cf, count(*) AS n FROM org WHERE cf IS NOT NULL GROUP BY cf),
     c AS (SELECT comp.cf, coalesce(f.n, 0) AS financial_count, coalesce(o.n, 0) AS project_count,
                  f.last AS latest_financial_year
           FROM comp LEFT JOIN f ON f.cf = comp.cf LEFT JOIN o ON o.cf = comp.cf
           WHERE (coalesce(f.n, 0) > 0 OR coalesce(o.n, 0) > 0) AND {match}),
     top AS (SELECT *, CAST(row_number() OVER (ORDER BY project_count DESC, financial_count DESC, cf)
             AS BIGINT) AS rank FROM c ORDER BY project_count DESC, financial_count DESC, cf LIMIT 300)
SELECT top.*, d.v AS company_name, k.v AS registry_comune, s.v AS registry_stato_impresa
FROM top LEFT JOIN ({first('denominazione')}) d ON d.cf = top.cf AND d.rn = 1
LEFT JOIN ({first('comune')}) k ON k.cf = top.cf AND k.rn = 1
LEFT JOIN ({first('stato_impresa')}) s ON s.cf = top.cf AND s.rn = 1"""


@query("Q5_connected_companies", connected_sql("TRUE"))
def _(t: Tables):
    return dashboards.connected_companies(t.comp, t.sites, t.fin, t.org, order=LINE_ORDER)


@query("Q5_connected_search", connected_sql("""
 (contains(comp.cf, 'ditta 1') OR comp.cf IN (SELECT cf FROM sites
  WHERE contains(lower(denominazione), 'ditta 1') OR contains(lower(comune), 'ditta 1')))"""))
def _(t: Tables):
    return dashboards.connected_companies(
        t.comp, t.sites, t.fin, t.org, query=" DITTA 1", order=LINE_ORDER
    )


@query("Q6_companies_per_year", """
SELECT *, round(company_count / max(company_count) OVER () * 100, 1) AS bar_width FROM
 (SELECT anno, CAST(count(DISTINCT cf) AS BIGINT) AS company_count FROM fin WHERE anno <> '' GROUP BY anno)""")
def _(t: Tables):
    return dashboards.companies_per_year(t.fin)


@query("Q6_revenue_per_year", f"""
SELECT *, round(revenue / max(revenue) OVER () * 100, 1) AS bar_width FROM
 (SELECT anno, round(sum({amount_sql('ricavi_delle_vendite')}), 2) AS revenue
  FROM fin WHERE anno <> '' GROUP BY anno)""")
def _(t: Tables):
    return dashboards.revenue_per_year(t.fin)


@query("Q6_revenue_ranking", f"""
WITH top AS (SELECT *, CAST(row_number() OVER (ORDER BY revenue DESC, cf) AS BIGINT) AS rank FROM
  (SELECT cf, round(sum({amount_sql('ricavi_delle_vendite')}), 2) AS revenue FROM fin
   WHERE anno = (SELECT max(anno) FROM fin WHERE anno <> '') GROUP BY cf)
  ORDER BY revenue DESC, cf LIMIT 20),
 names AS ({NAMES})
SELECT top.*, round(revenue / max(revenue) OVER () * 100, 1) AS bar_width,
       coalesce(company_name, top.cf) AS company_name
FROM top LEFT JOIN names ON names.cf = top.cf""")
def _(t: Tables):
    return dashboards.revenue_ranking(t.fin, t.comp, t.sites, LINE_ORDER)


@query("Q7_project_search", """
SELECT proj.projectID, acronym, status, coalesce(o.n, 0) AS organization_count,
       coalesce(o.c, 0) AS company_count, coalesce(v.n, 0) AS topic_count
FROM proj LEFT JOIN (SELECT projectID, count(*) AS n, CAST(count(DISTINCT cf) AS BIGINT) AS c
                     FROM org GROUP BY projectID) o ON o.projectID = proj.projectID
LEFT JOIN (SELECT projectID, count(*) AS n FROM voc GROUP BY projectID) v
  ON v.projectID = proj.projectID
WHERE contains(proj.projectID, '12') OR contains(lower(acronym), '12') OR contains(lower(title), '12')""")
def _(t: Tables):
    return dashboards.project_search(t.proj, t.org, t.voc, "12")


@query("Q8_company_search", f"""
WITH d AS (SELECT cf, denominazione AS v, row_number() OVER (PARTITION BY cf ORDER BY {LINE_ORDER_SQL}) AS rn
           FROM sites WHERE denominazione <> ''),
     k AS (SELECT cf, comune AS v, row_number() OVER (PARTITION BY cf ORDER BY {LINE_ORDER_SQL}) AS rn
           FROM sites WHERE comune <> ''),
     s AS (SELECT cf, stato_impresa AS v, row_number() OVER (PARTITION BY cf ORDER BY {LINE_ORDER_SQL}) AS rn
           FROM sites)
SELECT comp.cf, d.v AS company_name, k.v AS registry_comune, s.v AS registry_stato_impresa,
       (SELECT count(*) FROM sites WHERE sites.cf = comp.cf) AS filtered_count,
       (SELECT count(*) FROM fin WHERE fin.cf = comp.cf) AS financial_count,
       (SELECT count(*) FROM org WHERE org.cf = comp.cf) AS project_count,
       (SELECT max(anno) FROM fin WHERE fin.cf = comp.cf) AS latest_financial_year
FROM comp LEFT JOIN d ON d.cf = comp.cf AND d.rn = 1 LEFT JOIN k ON k.cf = comp.cf AND k.rn = 1
LEFT JOIN s ON s.cf = comp.cf AND s.rn = 1
WHERE contains(comp.cf, '3') OR comp.cf IN (SELECT cf FROM sites WHERE contains(lower(denominazione), '3'))""")
def _(t: Tables):
    return dashboards.company_search(t.comp, t.sites, t.fin, t.org, "3", LINE_ORDER)
