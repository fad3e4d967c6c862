"""Joins, set operations and first-row dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contains_ignoring_case, label_or, site_key, site_number
from ..operators.aggregates import first_nonblank
from ..operators.dedup import drop_repeated_when, keep_first, mark_repeated, repeated_keys
from ..operators.joins import (
    drop_matching, join_by, keep_matching, look_up, split_by_parent,
)
from ..operators.order import number_in_group
from ..operators.search import build_index, search
from ..plans import dashboards, financial, participation, registry
from ..sources.sinks import write_bucketed
from .base import Tables, query
from .bindings import LINE_ORDER, LINE_ORDER_SQL

LINE_KEYS = "cf, sede_ul, rea"
VAT_DIM = """
SELECT piva, cf FROM (SELECT piva, cf, row_number() OVER (PARTITION BY piva ORDER BY row_id) AS rn
FROM comp) WHERE rn = 1"""


def vat_dimension(t: Tables):
    return participation.vat_dimension(t.comp, ["row_id"])


@query("J1_company_id_join", f"""
WITH firsts AS (SELECT cf, min(pos) AS pos FROM
       (SELECT cf, row_number() OVER (ORDER BY {LINE_ORDER_SQL}) AS pos FROM reg) GROUP BY cf),
     ids AS (SELECT cf, row_number() OVER (ORDER BY pos) AS id_impresa FROM firsts)
SELECT reg.cf, sede_ul, rea, CAST(id_impresa AS BIGINT) AS id_impresa
FROM reg JOIN ids ON reg.cf = ids.cf""")
def _(t: Tables):
    sites = t.reg.select("cf", "sede_ul", "rea", F.struct(*LINE_ORDER).alias("row_id"))
    ids = registry.company_ids(sites).select("cf", "id_impresa")
    return join_by(sites, ids, ["cf"]).select("cf", "sede_ul", "rea", "id_impresa")


@query("J2_codes_to_sites", """
WITH k AS (SELECT cf || '_' || CASE WHEN substr(sede_ul, 4) = 'E' THEN '0'
                  ELSE substr(sede_ul, 4) END AS key_cfl, rea AS site_rea FROM reg)
SELECT key_cfl, ateco, ateco_tipo, site_rea
FROM (SELECT *, cf || '_' || loc_n AS key_cfl FROM codes) JOIN k USING (key_cfl)""")
def _(t: Tables):
    sites = t.reg.select(
        site_key(F.col("cf"), site_number(F.col("sede_ul"))).alias("key_cfl"),
        F.col("rea").alias("site_rea"),
    )
    codes = t.codes.withColumn("key_cfl", site_key(F.col("cf"), F.col("loc_n")))
    return join_by(codes, sites, ["key_cfl"]).select("key_cfl", "ateco", "ateco_tipo", "site_rea")


@query("J3_vat_to_tax_code", f"""
WITH dim AS ({VAT_DIM})
SELECT projectID, vatNumber, dim.cf AS tax_code
FROM org LEFT JOIN dim ON substr(vatNumber, 3) = dim.piva""")
def _(t: Tables):
    org = t.org.select("projectID", "vatNumber", F.substr("vatNumber", F.lit(3)).alias("vat"))
    dim = vat_dimension(t).withColumnRenamed("cf", "tax_code")
    return look_up(org, dim, "vat", "piva", ["tax_code"]).drop("vat")


@query("J4_names_onto_projects", f"""
WITH c AS (SELECT projectID, string_agg(name, ';' ORDER BY {LINE_ORDER_SQL}) AS coordinator
           FROM org_raw WHERE role = 'coordinator' GROUP BY projectID),
     p AS (SELECT projectID, string_agg(name, ';' ORDER BY {LINE_ORDER_SQL}) AS participants
           FROM org_raw WHERE role = 'participant' GROUP BY projectID)
SELECT id, acronym, coordinator, participants FROM proj_raw
LEFT JOIN c ON c.projectID = id LEFT JOIN p ON p.projectID = id""")
def _(t: Tables):
    lists = participation.name_lists(t.org_raw, LINE_ORDER)
    return participation.add_names(t.proj_raw.select("id", "acronym"), lists)


@query("J5_drop_companies_without_hq", f"""
SELECT {LINE_KEYS} FROM reg WHERE cf IN (SELECT cf FROM reg WHERE sede_ul = 'SEDE')""")
def _(t: Tables):
    sites = t.reg.select("cf", "sede_ul", "rea")
    return registry.only_with_headquarters(sites, sites)


@query("J6_projects_of_organisations", """
SELECT id, acronym FROM proj_raw WHERE id IN
  (SELECT projectID FROM org_raw WHERE country = 'IT' AND role = 'coordinator')""")
def _(t: Tables):
    org = t.org_raw.filter("country = 'IT' and role = 'coordinator'")
    return keep_matching(t.proj_raw.select("id", "acronym"), org, "id", "projectID")


@query("J7_regional_matches", f"""
WITH dim AS ({VAT_DIM}),
     hit AS (SELECT * FROM org_raw WHERE substr(vatNumber, 3) IN (SELECT piva FROM dim))
SELECT count(*) AS n_rows, CAST(count(DISTINCT substr(vatNumber, 3)) AS BIGINT) AS n_companies,
       CAST(count(DISTINCT projectID) AS BIGINT) AS n_projects FROM hit""")
def _(t: Tables):
    org = t.org_raw.withColumn("vatNumber", F.substr("vatNumber", F.lit(3)))
    hits = participation.regional_matches(org, vat_dimension(t))
    return hits.agg(
        F.count("*").alias("n_rows"), F.count_distinct("vatNumber").alias("n_companies"),
        F.count_distinct("projectID").alias("n_projects"),
    )


@query("J8_parent_check_counts", """
WITH parent AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS cf FROM orders WHERE o_orderstatus = 'P')
SELECT anno, count(*) FILTER (cf IN (SELECT cf FROM parent)) AS loaded,
       count(*) FILTER (cf NOT IN (SELECT cf FROM parent)) AS skipped
FROM fin GROUP BY anno""")
def _(t: Tables):
    parents = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("cf"))
    checked = split_by_parent(t.fin.select("cf", "anno"), parents, "cf")
    return checked.groupBy("anno").agg(
        F.count_if("has_parent").alias("loaded"), F.count_if(~F.col("has_parent")).alias("skipped")
    )


@query("J9_fact_to_project", """
SELECT organisationID, role, proj.projectID, acronym, frameworkProgramme
FROM org JOIN proj ON org.projectID = proj.projectID""")
def _(t: Tables):
    return join_by(
        t.org.select("projectID", "organisationID", "role"),
        t.proj.select("projectID", "acronym", "frameworkProgramme"), ["projectID"],
    )


@query("J10_name_or_key", """
SELECT projectID, organisationID, coalesce(nullif(denominazione, ''), org.cf) AS company_name
FROM org LEFT JOIN (SELECT cf, denominazione FROM comp WHERE prov <> 'NA') c ON c.cf = org.cf
WHERE org.cf IS NOT NULL""")
def _(t: Tables):
    org = t.org.filter("cf is not null").select("projectID", "organisationID", "cf")
    named = look_up(org, t.comp.filter("prov <> 'NA'"), "cf", "cf", ["denominazione"])
    return named.select(
        "projectID", "organisationID",
        label_or(F.col("denominazione"), F.col("cf")).alias("company_name"),
    )


@query("J11_first_nonblank_field", f"""
WITH d AS (SELECT cf, denominazione, row_number() OVER (PARTITION BY cf ORDER BY {LINE_ORDER_SQL}) AS rn
           FROM sites WHERE denominazione <> ''),
     c AS (SELECT cf, comune, row_number() OVER (PARTITION BY cf ORDER BY {LINE_ORDER_SQL}) AS rn
           FROM sites WHERE comune <> '')
SELECT comp.cf, d.denominazione AS company_name, c.comune AS registry_comune
FROM comp LEFT JOIN d ON d.cf = comp.cf AND d.rn = 1 LEFT JOIN c ON c.cf = comp.cf AND c.rn = 1""")
def _(t: Tables):
    fields = {"denominazione": "company_name", "comune": "registry_comune"}
    first = first_nonblank(t.sites, "cf", fields, LINE_ORDER)
    return look_up(t.comp.select("cf"), first, "cf", "cf", list(fields.values()))


@query("J12_counts_without_fan_out", """
SELECT comp.cf, CAST(count(DISTINCT fin.rea) AS BIGINT) AS financial_count,
       (SELECT count(*) FROM org WHERE org.cf = comp.cf) AS project_count
FROM comp LEFT JOIN fin ON fin.cf = comp.cf GROUP BY comp.cf""")
def _(t: Tables):
    return dashboards.connected_counts(t.comp, t.fin, t.org).select(
        "cf", "financial_count", "project_count"
    )


@query("J13_company_children", f"""
WITH s AS (SELECT cf, sede, row_number() OVER (PARTITION BY cf ORDER BY {LINE_ORDER_SQL}) AS place
           FROM (SELECT *, comune || '|' || stato_impresa AS sede FROM sites)),
     f AS (SELECT cf, anno, rea, row_number() OVER (PARTITION BY cf ORDER BY anno DESC, rea) AS place
           FROM fin)
SELECT comp.cf,
       (SELECT string_agg(sede, ';' ORDER BY place) FROM s WHERE s.cf = comp.cf AND place <= 10) AS sites,
       (SELECT string_agg(anno || ':' || rea, ';' ORDER BY place) FROM f
        WHERE f.cf = comp.cf AND place <= 10) AS statements
FROM comp""")
def _(t: Tables):
    shown = dashboards.first_children(t.sites, LINE_ORDER)
    sites = dashboards.nested_children(shown, ["comune", "stato_impresa"], "site_list")
    stated = dashboards.first_children(t.fin, [F.desc("anno"), "rea"])
    statements = dashboards.nested_children(stated, ["anno", "rea"], "statement_list")
    nested = look_up(t.comp.select("cf"), sites, "cf", "cf", ["site_list"])
    nested = look_up(nested, statements, "cf", "cf", ["statement_list"])

    def listed(column: str, left: str, mark: str, right: str):
        texts = F.transform(column, lambda x: F.concat(x[left], F.lit(mark), x[right]))
        return F.array_join(texts, ";")

    return nested.select(
        "cf", listed("site_list", "comune", "|", "stato_impresa").alias("sites"),
        listed("statement_list", "anno", ":", "rea").alias("statements"),
    )


@query("J14_project_children", f"""
SELECT proj.projectID, acronym, organisationID, name, CAST(row_number() OVER
       (PARTITION BY org.projectID ORDER BY organisationID, {LINE_ORDER_SQL}) AS BIGINT) AS place
FROM org JOIN proj ON proj.projectID = org.projectID""")
def _(t: Tables):
    org = t.org.select("projectID", "organisationID", "name", *LINE_ORDER)
    placed = dashboards.project_children(org, ["organisationID", *LINE_ORDER])
    return join_by(placed, t.proj.select("projectID", "acronym"), ["projectID"]).select(
        "projectID", "acronym", "organisationID", "name", "place"
    )


@query("J15_search_through_children", """
SELECT cf FROM comp WHERE contains(cf, '42') OR cf IN
  (SELECT cf FROM sites WHERE contains(lower(denominazione), '42') OR contains(lower(comune), '42'))""")
def _(t: Tables):
    return dashboards.matching_companies(
        t.comp.select("cf"), t.sites, "42", ["denominazione", "comune"]
    )


@query("J13_colocated_children", """
SELECT comp.cf, denominazione, fin.anno, fin.rea FROM fin JOIN comp ON comp.cf = fin.cf""")
def _(t: Tables):
    """Companies and statements exported in buckets of the tax code, joined where they lie."""
    companies = write_bucketed(t.comp.select("cf", "denominazione"), "companies", "cf", 16)
    stated = write_bucketed(t.fin.select("cf", "anno", "rea"), "statements", "cf", 16)
    return join_by(stated, companies, ["cf"], colocated=True).select("cf", "denominazione", "anno", "rea")


@query("P21_indexed_search", """
SELECT cf, denominazione, comune FROM comp
WHERE contains(lower(cf), 'omer#00000007') OR contains(lower(denominazione), 'omer#00000007')
   OR contains(lower(comune), 'omer#00000007')""")
def _(t: Tables):
    fields = ["cf", "denominazione", "comune"]
    return search(build_index(t.comp.select(*fields), fields), "OMER#00000007").select(*fields)


@query("J15_indexed_search", """
SELECT cf FROM comp WHERE contains(cf, 'tta 12') OR cf IN
  (SELECT cf FROM sites WHERE contains(lower(denominazione), 'tta 12') OR contains(lower(comune), 'tta 12'))""")
def _(t: Tables):
    """Companies found through the index of their registry rows."""
    index = build_index(t.sites.select("cf", "denominazione", "comune"), ["denominazione", "comune"])
    own = t.comp.select("cf").filter(contains_ignoring_case(F.col("cf"), "tta 12"))
    return keep_matching(t.comp.select("cf"), search(index, "tta 12"), "cf").unionByName(own).distinct()


CURRENT = "SELECT trim(cf) AS cf, anno FROM fin_raw WHERE o_orderstatus = 'P'"
PREVIOUS = "SELECT trim(cf) AS cf, anno FROM fin_raw WHERE o_orderstatus <> 'P'"


@query("J16_carry_forward", f"""
WITH cur AS ({CURRENT}), prev AS ({PREVIOUS})
SELECT cf, anno FROM cur UNION ALL
(SELECT DISTINCT cf, anno FROM prev WHERE cf NOT IN (SELECT cf FROM cur))""")
def _(t: Tables):
    rows = t.fin_raw.select(F.trim("cf").alias("cf"), "anno", "o_orderstatus")
    current = rows.filter("o_orderstatus = 'P'").drop("o_orderstatus")
    previous = rows.filter("o_orderstatus <> 'P'").drop("o_orderstatus")
    return financial.carry_forward(current, previous)


# --- marking and removing repeated keys --------------------------------------------
@query("W2_mark_repeated", f"""
SELECT {LINE_KEYS}, CASE WHEN count(*) OVER (PARTITION BY cf, sede_ul) > 1 THEN 1 ELSE 0 END AS two_key,
       CASE WHEN count(*) OVER (PARTITION BY cf, sede_ul, prov) > 1 THEN 1 ELSE 0 END AS three_key
FROM reg""")
def _(t: Tables):
    marked = mark_repeated(t.reg.select("cf", "sede_ul", "rea", "prov"), ["cf", "sede_ul"], "two_key")
    marked = mark_repeated(marked, ["cf", "sede_ul", "prov"], "three_key")
    return marked.select(
        "cf", "sede_ul", "rea", F.col("two_key").cast("int"), F.col("three_key").cast("int")
    )


@query("W2_repeated_codes", """
SELECT cf, loc_n, count(*) AS n_rows FROM codes
GROUP BY cf, prov, rea, loc_n, ateco_tipo, ateco, ateco_desc HAVING count(*) > 1
UNION ALL SELECT cf, loc_n, count(*) FROM codes GROUP BY cf, loc_n HAVING count(*) > 2""")
def _(t: Tables):
    seven = ["cf", "prov", "rea", "loc_n", "ateco_tipo", "ateco", "ateco_desc"]
    codes = t.codes
    full = repeated_keys(codes, seven).select("cf", "loc_n", "n_rows")
    site = repeated_keys(codes, ["cf", "loc_n"]).filter("n_rows > 2")
    return full.unionByName(site)


@query("W3_drop_foreign_duplicates", f"""
SELECT {LINE_KEYS}, prov FROM (SELECT *, count(*) OVER (PARTITION BY cf, sede_ul) AS n FROM reg)
WHERE NOT (n > 1 AND prov <> prov_camera_commercio)""")
def _(t: Tables):
    return drop_repeated_when(
        t.reg, ["cf", "sede_ul"], F.col("prov") != F.col("prov_camera_commercio")
    ).select("cf", "sede_ul", "rea", "prov")


@query("W4_first_per_key", f"""
SELECT cf, sede_ul, rea FROM
  (SELECT *, row_number() OVER (PARTITION BY cf ORDER BY {LINE_ORDER_SQL}) AS rn FROM reg) WHERE rn = 1""")
def _(t: Tables):
    return keep_first(t.reg, ["cf"], LINE_ORDER).select("cf", "sede_ul", "rea")


@query("W5_insert_or_ignore", f"""
SELECT cf, denominazione FROM
  (SELECT *, row_number() OVER (PARTITION BY cf ORDER BY {LINE_ORDER_SQL}) AS rn FROM sites) WHERE rn = 1""")
def _(t: Tables):
    return keep_first(t.sites, ["cf"], LINE_ORDER).select("cf", "denominazione")


# --- set operations -----------------------------------------------------------------
@query("U1_union_by_name", """
SELECT id, acronym, startDate, NULL AS frameworkProgramme FROM proj_raw WHERE frameworkProgramme = 'H2020'
UNION ALL SELECT id, NULL, startDate, frameworkProgramme FROM proj_raw
WHERE frameworkProgramme IS DISTINCT FROM 'H2020'""")
def _(t: Tables):
    raw = t.proj_raw
    first = raw.filter("frameworkProgramme = 'H2020'").drop("frameworkProgramme")
    second = raw.filter("not frameworkProgramme <=> 'H2020'").drop("acronym")
    return first.unionByName(second, allowMissingColumns=True)


@query("U2_union_current_and_past", f"{CURRENT} UNION ALL {PREVIOUS}")
def _(t: Tables):
    rows = t.fin_raw.select(F.trim("cf").alias("cf"), "anno", "o_orderstatus")
    return rows.filter("o_orderstatus = 'P'").unionByName(
        rows.filter("o_orderstatus <> 'P'")
    ).drop("o_orderstatus")


@query("U3_distinct_rows", "SELECT DISTINCT cf, anno FROM fin")
def _(t: Tables):
    return t.fin.select("cf", "anno").distinct()


@query("U4_key_difference", f"""
WITH cur AS ({CURRENT}), prev AS ({PREVIOUS})
SELECT cf, 'vanished' AS side FROM (SELECT cf FROM prev EXCEPT SELECT cf FROM cur)
UNION ALL SELECT cf, 'kept' FROM (SELECT cf FROM prev INTERSECT SELECT cf FROM cur)""")
def _(t: Tables):
    rows = t.fin_raw.select(F.trim("cf").alias("cf"), "o_orderstatus")
    current = rows.filter("o_orderstatus = 'P'").select("cf").distinct()
    previous = rows.filter("o_orderstatus <> 'P'").select("cf").distinct()
    gone = drop_matching(previous, current, "cf").withColumn("side", F.lit("vanished"))
    return gone.unionByName(
        keep_matching(previous, current, "cf").withColumn("side", F.lit("kept"))
    )


@query("L5_children_in_order", f"""
SELECT cf, anno, rea, CAST(row_number() OVER (PARTITION BY cf ORDER BY anno DESC, rea) AS BIGINT) AS place
FROM fin""")
def _(t: Tables):
    fin = t.fin.select("cf", "anno", "rea")
    return number_in_group(fin, ["cf"], [F.desc("anno"), "rea"], "place")
