"""Survivorship, numbering, shares, sorting and top-k."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import age_years, date_or_null, repair_shifted_year, site_key, site_number
from ..operators.aggregates import distinct_per_group, frequencies
from ..operators.dedup import rank_within
from ..operators.order import number_rows
from ..operators.shares import add_widths, shares_of_shown, top_rows
from ..plans import dashboards, registry
from .base import Tables, query
from .bindings import LINE_ORDER, LINE_ORDER_SQL
from .columns import AS_OF, REPAIRED, SCRUBBED
from .totals import A9, A10, DATES


@query("W1_best_headquarters", f"""
SELECT cf, rea, prov, denominazione FROM (
  SELECT *, row_number() OVER (PARTITION BY cf ORDER BY latest DESC NULLS LAST, cancelled,
    denominazione DESC, prov, rea, id_localiz) AS rn
  FROM (SELECT cf, rea, prov, denominazione, greatest({', '.join(DATES.values())}) AS latest,
               CASE WHEN {REPAIRED.format('data_canc')} IS NULL THEN 0 ELSE 1 END AS cancelled,
               row_number() OVER (ORDER BY {LINE_ORDER_SQL}) AS id_localiz, sede_ul FROM reg)
  WHERE sede_ul = 'SEDE') WHERE rn = 1""")
def _(t: Tables):
    sites = t.reg.withColumns({
        c: date_or_null(repair_shifted_year(F.col(c))) for c in registry.date_columns(t.reg)
    }).withColumn("id_localiz", F.struct(*LINE_ORDER))
    return registry.best_headquarters(sites).select("cf", "rea", "prov", "denominazione")


IDS = f"""
WITH firsts AS (SELECT cf, min(pos) AS pos FROM
       (SELECT cf, row_number() OVER (ORDER BY {LINE_ORDER_SQL}) AS pos FROM reg) GROUP BY cf)
SELECT cf, CAST(row_number() OVER (ORDER BY pos) AS BIGINT) AS id_impresa FROM firsts"""


@query("W6_dense_company_ids", IDS)
def _(t: Tables):
    sites = t.reg.select("cf", "sede_ul", F.struct(*LINE_ORDER).alias("row_id"))
    return registry.company_ids(sites).select("cf", "id_impresa")


@query("W7_row_ids", f"""
SELECT cf, sede_ul, rea, CAST(row_number() OVER (ORDER BY {LINE_ORDER_SQL}) AS BIGINT) AS id_localiz
FROM reg""")
def _(t: Tables):
    rows = t.reg.select("cf", "sede_ul", "rea", *LINE_ORDER)
    return number_rows(rows, LINE_ORDER, "id_localiz").select("cf", "sede_ul", "rea", "id_localiz")


KEY = "cf || '_' || CASE WHEN substr(sede_ul, 4) = 'E' THEN '0' ELSE substr(sede_ul, 4) END"


@query("W8_age_order", f"""
SELECT cf, sede_ul, rea, CAST(row_number() OVER (ORDER BY DATE '{AS_OF}' - {DATES['data_cost']} DESC
       NULLS LAST, {KEY} DESC, {LINE_ORDER_SQL}) AS BIGINT) AS age_rank FROM reg""")
def _(t: Tables):
    rows = t.reg.select(
        "cf", "sede_ul", "rea",
        age_years(F.lit(AS_OF), date_or_null(repair_shifted_year(F.col("data_cost")))).alias("anni"),
        site_key(F.col("cf"), site_number(F.col("sede_ul"))).alias("key_cfl"), *LINE_ORDER,
    )
    order = [F.desc_nulls_last("anni"), F.desc("key_cfl"), *LINE_ORDER]
    return number_rows(rows, order, "age_rank").select("cf", "sede_ul", "rea", "age_rank")


SHARES = """
WITH top AS (SELECT prov, n, CAST(row_number() OVER (ORDER BY n DESC, prov) AS BIGINT) AS rank
  FROM (SELECT prov, CAST(count(DISTINCT cf) AS BIGINT) AS n FROM sites GROUP BY prov)
  ORDER BY n DESC, prov LIMIT 4),
 s AS (SELECT *, round(n / sum(n) OVER () * 100, 1) AS pct_of_shown FROM top)
SELECT *, round(sum(pct_of_shown) OVER (ORDER BY rank), 1) AS slice_end,
       round(sum(pct_of_shown) OVER (ORDER BY rank) - pct_of_shown, 1) AS slice_start FROM s"""


@query("W9_shares_of_shown", SHARES)
def _(t: Tables):
    counted = distinct_per_group(t.sites, ["prov"], "cf", "n")
    return shares_of_shown(top_rows(counted, [F.desc("n"), F.asc("prov")], 4), "n")


@query("W10_scale_to_largest", """
SELECT cf, n, round(n / max(n) OVER () * 100, 1) AS bar_width
FROM (SELECT cf, count(*) AS n FROM fin GROUP BY cf)""")
def _(t: Tables):
    return add_widths(frequencies(t.fin, "cf"), {"n": "bar_width"})


@query("W11_first_children", """
SELECT cf, anno, rea, CAST(place AS BIGINT) AS place FROM
  (SELECT *, row_number() OVER (PARTITION BY cf ORDER BY anno DESC, rea) AS place FROM fin)
WHERE place <= 10""")
def _(t: Tables):
    shown = rank_within(t.fin, ["cf"], [F.desc("anno"), "rea"], 10, "place")
    return shown.select("cf", "anno", "rea", F.col("place").cast("bigint").alias("place"))


@query("L1_mixed_direction_sort", f"""
SELECT cf, rea, prov, CAST(row_number() OVER (ORDER BY prov DESC, {DATES['data_canc']} ASC NULLS LAST,
       cf, {LINE_ORDER_SQL}) AS BIGINT) AS place FROM reg""")
def _(t: Tables):
    rows = t.reg.select(
        "cf", "rea", "prov", date_or_null(repair_shifted_year(F.col("data_canc"))).alias("day"),
        *LINE_ORDER,
    )
    order = [F.desc_nulls_last("prov"), F.asc_nulls_last("day"), F.asc("cf"), *LINE_ORDER]
    return number_rows(rows, order, "place").select("cf", "rea", "prov", "place")


@query("L2_top_six", """
SELECT tipo_impresa, company_count, CAST(row_number() OVER (ORDER BY company_count DESC, tipo_impresa)
       AS BIGINT) AS rank
FROM (SELECT tipo_impresa, CAST(count(DISTINCT cf) AS BIGINT) AS company_count FROM sites
      WHERE tipo_impresa <> '' GROUP BY 1) ORDER BY company_count DESC, tipo_impresa LIMIT 6""")
def _(t: Tables):
    counted = distinct_per_group(
        t.sites.filter("tipo_impresa <> ''"), ["tipo_impresa"], "cf", "company_count"
    )
    return top_rows(counted, [F.desc("company_count"), F.asc("tipo_impresa")], 6)


@query("L3_top_twenty", f"""
SELECT *, CAST(row_number() OVER (ORDER BY total_amount DESC, cf) AS BIGINT) AS rank FROM ({A9})
ORDER BY total_amount DESC, cf LIMIT 20""")
def _(t: Tables):
    totals = dashboards.contribution_by_company(t.org, t.proj)
    return top_rows(totals, [F.desc("total_amount"), F.asc("cf")], 20)


@query("L4_ranked_list", """
SELECT *, CAST(row_number() OVER (ORDER BY project_count DESC, financial_count DESC, cf) AS BIGINT) AS rank
FROM (SELECT comp.cf, (SELECT count(*) FROM org WHERE org.cf = comp.cf) AS project_count,
             (SELECT count(*) FROM fin WHERE fin.cf = comp.cf) AS financial_count FROM comp)
ORDER BY project_count DESC, financial_count DESC, cf LIMIT 300""")
def _(t: Tables):
    counts = dashboards.connected_counts(t.comp, t.fin, t.org).drop("latest_financial_year")
    return top_rows(counts, [F.desc("project_count"), F.desc("financial_count"), F.asc("cf")], 300)


@query("L6_sorted_years", """
SELECT anno, n, CAST(row_number() OVER (ORDER BY anno) AS BIGINT) AS place
FROM (SELECT anno, count(*) AS n FROM fin WHERE anno <> '' GROUP BY anno)""")
def _(t: Tables):
    return number_rows(frequencies(dashboards.with_year(t.fin), "anno"), ["anno"], "place")


@query("L7_head", f"""
SELECT title, total_count, CAST(row_number() OVER (ORDER BY total_count DESC, title) AS BIGINT) AS rank
FROM ({A10}) ORDER BY total_count DESC, title LIMIT 5""")
def _(t: Tables):
    counted = dashboards.topic_counts(t.voc, t.proj).select("title", "total_count")
    return top_rows(counted, [F.desc("total_count"), F.asc("title")], 5)
