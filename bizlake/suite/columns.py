"""Projections, filters and column functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import config
from ..functions import (
    age_years, contains_ignoring_case, date_or_null, day_first_date, decimal_comma,
    label_or, normalise_identifier, null_when_token, parse_amount, programme_label,
    repair_shifted_year, scrub, site_key, site_number, strict_date, strip_country_prefix,
    topic_level_1, topic_level_2, trim_or_empty, year_text,
)
from ..operators.aggregates import funnel
from ..plans import dashboards, financial, registry, serving
from ..sources.delimited import require_column_count, require_columns
from ..sources.files import digest
from ..sources.sinks import layout_columns
from .base import Tables, query
from .bindings import LINE_ORDER_SQL

AS_OF = dt.date(2024, 6, 30)
LINE_KEYS = "cf, sede_ul, rea"

# ISO text of a shifted date in SQL, null where the century is not a shifted one
REPAIRED = (
    "CASE WHEN substr({0}, 1, 2) IN ('48','49','50','51') AND length(substr({0}, 1, 10)) >= 4 "
    "THEN CAST(CAST(substr({0}, 1, 2) AS INT) - 30 AS VARCHAR) || substr(substr({0}, 1, 10), 3) END"
)
SCRUBBED = r"""trim(regexp_replace({0}, '[\n\t\r"''|#\-*]|_x000D_', ' ', 'g'), E' \n\t\r')"""
STRIPPED = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"


# --- projections ----------------------------------------------------------------
RENAMES = {"denominazione": "company", "prov": "province", "absent": "ignored"}


@query("P1_rename_by_map", "SELECT cf, denominazione AS company, prov AS province FROM comp")
def _(t: Tables):
    return t.comp.select("cf", "denominazione", "prov").withColumnsRenamed(RENAMES)


@query("P2_positional_rename", f"SELECT {', '.join(config.FINANCIAL_COLUMNS)} FROM fin_raw")
def _(t: Tables):
    raw = t.fin_raw.drop("o_orderkey", "o_orderstatus")
    numbered = raw.toDF(*[f"c{i}" for i in range(len(raw.columns))])
    return financial.with_safe_names(numbered)


@query("P3_rename_columns", 'SELECT name AS participants, projectID AS "id" FROM org')
def _(t: Tables):
    return t.org.select("projectID", "name").withColumnsRenamed(
        {"name": "participants", "projectID": "id"}
    )


@query("P4_lineage_columns", "SELECT cf, sede_ul, 'I' AS fonte, '05_2024' AS mm_aaaa FROM reg")
def _(t: Tables):
    return registry.with_source(t.reg.select("cf", "sede_ul"), "05_2024")


def company_layout(t: Tables):
    """Layout of the company exports: column names with their place in two exports."""
    return t.spark.createDataFrame(
        [("comune", 3.0, None), ("cf", 1.0, 2.0), ("denominazione", 2.0, 1.0), ("tel", None, 3.0)],
        "nomi_colonne_corretti string, ordine_repo double, ordine_portale double",
    )


@query("P5_ordered_layout", "SELECT denominazione, cf, tel FROM comp")
def _(t: Tables):
    return t.comp.select(*layout_columns(company_layout(t), "nomi_colonne_corretti", "ordine_portale"))


@query("S2_layout_config", "SELECT cf, denominazione, comune FROM comp")
def _(t: Tables):
    return t.comp.select(*layout_columns(company_layout(t), "nomi_colonne_corretti", "ordine_repo"))


@query("P6_drop_columns", "SELECT cf, prov, rea FROM reg")
def _(t: Tables):
    return t.reg.select("cf", "prov", "rea", "piva", "comune").drop("piva", "comune", "absent")


@query("P7_columns_by_prefix",
       "SELECT data_isc_ri, data_cost, data_canc, data_fall, data_cess_att FROM reg")
def _(t: Tables):
    reg = t.reg
    return reg.select(*registry.date_columns(reg))


@query("P8_joined_site_class", f"""
SELECT cf, sede_ul, rea, tipo_sedeul_1 || tipo_sedeul_2 || tipo_sedeul_3 || tipo_sedeul_4
       || tipo_sedeul_5 AS tipo_sedeul FROM reg""")
def _(t: Tables):
    reg = t.reg.select("cf", "sede_ul", "rea", *config.SITE_CLASS_COLUMNS)
    return registry.with_site_class(reg)


@query("P9_column_subset", "SELECT projectID, name, role FROM org")
def _(t: Tables):
    return t.org.select("projectID", "name", "role")


@query("P10_site_flag",
       f"SELECT {LINE_KEYS}, CASE WHEN sede_ul = 'SEDE' THEN 's' ELSE 'u' END AS flag FROM reg")
def _(t: Tables):
    return t.reg.select("cf", "sede_ul", "rea", registry.site_flag().alias("flag"))


@query("P11_serving_projection", "SELECT " + ", ".join(
    f'{STRIPPED.format(c)} AS "{c}"' if c in ("cf", "prov", "rea", "tipo_impresa", "denominazione",
                                             "comune", "piva", "tel", "stato_impresa")
    else f"'' AS \"{c}\"" for c in config.COMPANY_COLUMNS) + " FROM comp")
def _(t: Tables):
    return serving.serving_columns(t.comp, config.COMPANY_COLUMNS)


@query("P12_label_or_default", """
SELECT projectID, coalesce(nullif(euroSciVocTitle, ''), 'Non classificato') AS title FROM voc""")
def _(t: Tables):
    return t.voc.select(
        "projectID", label_or(F.col("euroSciVocTitle"), config.UNCLASSIFIED_TOPIC).alias("title")
    )


# --- filters --------------------------------------------------------------------
@query("P13_in_and_not_in", """
SELECT projectID, role, vatNumber FROM org_raw
WHERE country IN ('IT') AND (vatNumber NOT IN ('MISSING','NOTAPPLICABLE','VATEXEMPTION')
      OR vatNumber IS NULL)""")
def _(t: Tables):
    vat = F.col("vatNumber")
    return t.org_raw.filter(
        F.col("country").isin("IT") & (~vat.isin(config.NO_VAT) | vat.isNull())
    ).select("projectID", "role", "vatNumber")


@query("P14_blank_key_to_null", """
SELECT projectID, vatNumber FROM org_raw WHERE nullif(vatNumber, '') IS NOT NULL""")
def _(t: Tables):
    return t.org_raw.select("projectID", F.nullif("vatNumber", F.lit("")).alias("vatNumber")).filter(
        F.col("vatNumber").isNotNull()
    )


@query("P15_exact_length", """
SELECT projectID, substr(vatNumber, 3) AS vatNumber FROM org_raw
WHERE length(substr(vatNumber, 3)) = 11""")
def _(t: Tables):
    stripped = t.org_raw.select("projectID", strip_country_prefix(F.col("vatNumber")).alias("vatNumber"))
    return stripped.filter(F.length("vatNumber") == config.VAT_DIGITS)


@query("P16_home_scope", f"""
SELECT {LINE_KEYS}, prov FROM reg WHERE sede_ul = 'SEDE' OR prov IN ('GO','PN','UD','TS')""")
def _(t: Tables):
    keep = registry.in_scope(F.col("sede_ul"), F.col("prov"), config.HEADQUARTERS)
    return t.reg.filter(keep).select("cf", "sede_ul", "rea", "prov")


@query("P17_columns_differ", f"""
SELECT {LINE_KEYS}, prov, prov_camera_commercio FROM reg WHERE prov <> prov_camera_commercio""")
def _(t: Tables):
    return t.reg.filter(F.col("prov") != F.col("prov_camera_commercio")).select(
        "cf", "sede_ul", "rea", "prov", "prov_camera_commercio"
    )


@query("P18_blank_key_skip", "SELECT trim(tel) AS cf, denominazione FROM comp WHERE trim(tel) <> ''")
def _(t: Tables):
    return serving.with_key(
        t.comp.select(trim_or_empty(F.col("tel")).alias("cf"), "denominazione"), "cf"
    )


@query("P19_blank_exclusion", """
SELECT cf, rea, anno FROM fin WHERE anno <> '' AND ricavi_delle_vendite IS NOT NULL""")
def _(t: Tables):
    rows = dashboards.with_year(t.fin).filter(F.col("ricavi_delle_vendite").isNotNull())
    return rows.select("cf", "rea", "anno")


@query("P20_default_latest_year", """
SELECT cf, rea, anno FROM fin WHERE anno = (SELECT max(anno) FROM fin WHERE anno <> '')""")
def _(t: Tables):
    fin = t.fin
    latest = dashboards.with_year(fin).select(F.max("anno")).scalar()
    return fin.filter(F.col("anno") == latest).select("cf", "rea", "anno")


@query("P21_substring_search", """
SELECT cf, denominazione, comune FROM comp
WHERE contains(lower(cf), '77') OR contains(lower(denominazione), '77')
   OR contains(lower(comune), '77')""")
def _(t: Tables):
    hit = [contains_ignoring_case(F.col(c), "77") for c in ("cf", "denominazione", "comune")]
    return t.comp.filter(hit[0] | hit[1] | hit[2]).select("cf", "denominazione", "comune")


@query("P22_column_count_guard",
       "SELECT 21 AS n_columns, CAST(count(*) AS BIGINT) AS n_rows FROM fin_raw")
def _(t: Tables):
    raw = require_column_count(t.fin_raw.drop("o_orderkey", "o_orderstatus"), 21)
    return raw.agg(F.lit(len(raw.columns)).alias("n_columns"), F.count("*").alias("n_rows"))


@query("P23_missing_column_guard", "SELECT cf, denominazione FROM comp")
def _(t: Tables):
    return require_columns(t.comp, ["cf", "denominazione"]).select("cf", "denominazione")


@query("P24_programme_whitelist", """
SELECT projectID, frameworkProgramme FROM proj
WHERE frameworkProgramme IN ('H2020','HORIZON EUROPE')""")
def _(t: Tables):
    return dashboards.of_programmes(t.proj).select("projectID", "frameworkProgramme")


@query("P25_having_any_child", """
WITH f AS (SELECT cf, count(*) AS n FROM fin GROUP BY cf),
     o AS (SELECT cf, count(*) AS n FROM org WHERE cf IS NOT NULL GROUP BY cf)
SELECT comp.cf, CAST(coalesce(f.n, 0) AS BIGINT) AS financial_count,
       CAST(coalesce(o.n, 0) AS BIGINT) AS project_count
FROM comp LEFT JOIN f ON f.cf = comp.cf LEFT JOIN o ON o.cf = comp.cf
WHERE coalesce(f.n, 0) > 0 OR coalesce(o.n, 0) > 0""")
def _(t: Tables):
    return dashboards.connected_counts(t.comp, t.fin, t.org).filter(
        "financial_count > 0 or project_count > 0"
    ).select("cf", "financial_count", "project_count")


# --- functions ------------------------------------------------------------------
@query("F1_site_number", """
SELECT cf, sede_ul, CASE WHEN substr(sede_ul, 4) = 'E' THEN '0' ELSE substr(sede_ul, 4) END AS n_sede
FROM reg""")
def _(t: Tables):
    return t.reg.select("cf", "sede_ul", site_number(F.col("sede_ul")).alias("n_sede"))


@query("F2_scrub_text", f"""
SELECT cf, {SCRUBBED.format('denominazione')} AS denominazione,
       {SCRUBBED.format('descrizione_attivita')} AS descrizione_attivita,
       {SCRUBBED.format('indirizzo')} AS indirizzo FROM reg""")
def _(t: Tables):
    return t.reg.select("cf", *[scrub(F.col(c)).alias(c) for c in config.REGISTRY_TEXT_COLUMNS])


@query("F2_scrub_documents", rf"""
SELECT doc_id, regexp_replace(regexp_replace(text, '[\n\t\r"''|#\-*]|_x000D_', ' ', 'g'),
       '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS cleaned FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", scrub(F.col("text")).alias("cleaned"))


@query("F3_site_key", """
SELECT cf || '_' || CASE WHEN substr(sede_ul, 4) = 'E' THEN '0' ELSE substr(sede_ul, 4) END
       AS key_cfl FROM reg""")
def _(t: Tables):
    return t.reg.select(site_key(F.col("cf"), site_number(F.col("sede_ul"))).alias("key_cfl"))


@query("F4_year_shift_repair", f"""
SELECT cf, sede_ul, {', '.join(f"{REPAIRED.format(c)} AS {c}" for c in
       ('data_isc_ri', 'data_cost', 'data_canc', 'data_fall', 'data_cess_att'))} FROM reg""")
def _(t: Tables):
    reg = t.reg
    return reg.select(
        "cf", "sede_ul",
        *[repair_shifted_year(F.col(c)).alias(c) for c in registry.date_columns(reg)],
    )


@query("F5_strict_date", f"""
SELECT cf, sede_ul, CAST(CAST({REPAIRED.format('data_isc_ri')} AS DATE) AS VARCHAR) AS day FROM reg""")
def _(t: Tables):
    day = strict_date(repair_shifted_year(F.col("data_isc_ri")))
    return t.reg.select("cf", "sede_ul", day.cast("string").alias("day"))


@query("F6_date_or_null", """
SELECT id, CAST(TRY_CAST(startDate AS DATE) AS VARCHAR) AS day FROM proj_raw""")
def _(t: Tables):
    return t.proj_raw.select("id", date_or_null(F.col("startDate")).cast("string").alias("day"))


@query("F7_day_first_date", """
SELECT projectID, CAST(CAST(try_strptime(contentUpdateDate, ['%Y-%m-%d %H:%M:%S', '%d/%m/%Y'])
       AS DATE) AS VARCHAR) AS day FROM org_raw""")
def _(t: Tables):
    day = day_first_date(F.col("contentUpdateDate"))
    return t.org_raw.select("projectID", day.cast("string").alias("day"))


@query("F8_age_in_years", f"""
SELECT cf, sede_ul, round((DATE '{AS_OF}' - CAST({REPAIRED.format('data_cost')} AS DATE)) / 365.0, 6)
       AS anni FROM reg""")
def _(t: Tables):
    since = date_or_null(repair_shifted_year(F.col("data_cost")))
    return t.reg.select("cf", "sede_ul", F.round(age_years(F.lit(AS_OF), since), 6).alias("anni"))


@query("F9_strip_country_prefix", "SELECT projectID, substr(vatNumber, 3) AS vat FROM org_raw")
def _(t: Tables):
    return t.org_raw.select("projectID", strip_country_prefix(F.col("vatNumber")).alias("vat"))


@query("F10_text_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("F11_decimal_comma",
       "SELECT projectID, replace(ecContribution, '.', ',') AS ecContribution FROM org_raw")
def _(t: Tables):
    return t.org_raw.select(
        "projectID", decimal_comma(F.col("ecContribution")).alias("ecContribution")
    )


@query("F12_path_level_1", """
SELECT projectID, string_split(euroSciVocPath, '/')[2] AS livello_1 FROM voc""")
def _(t: Tables):
    return t.voc.select("projectID", topic_level_1(F.col("euroSciVocPath")).alias("livello_1"))


@query("F13_path_level_2", """
SELECT projectID, euroSciVocPath,
       coalesce(string_split(euroSciVocPath, '/')[3], string_split(euroSciVocPath, '/')[2])
       AS when_missing,
       coalesce(nullif(string_split(euroSciVocPath, '/')[3], ''),
                string_split(euroSciVocPath, '/')[2]) AS when_blank FROM voc""")
def _(t: Tables):
    path = F.col("euroSciVocPath")
    return t.voc.select(
        "projectID", "euroSciVocPath", topic_level_2(path, False).alias("when_missing"),
        topic_level_2(path, True).alias("when_blank"),
    )


@query("F14_programme_label", """
SELECT id, replace(frameworkProgramme, 'HORIZON', 'HORIZON EUROPE') AS frameworkProgramme
FROM proj_raw""")
def _(t: Tables):
    return t.proj_raw.select(
        "id", programme_label(F.col("frameworkProgramme")).alias("frameworkProgramme")
    )


@query("F15_normalise_identifier",
       "SELECT o_orderkey, trim(replace(coalesce(chr(65279) || cf, ''), chr(65279), '')) AS id FROM fin_raw")
def _(t: Tables):
    marked = F.concat(F.lit("\ufeff"), "cf")
    return t.fin_raw.select("o_orderkey", normalise_identifier(marked).alias("id"))


@query("F16_trim_or_empty", "SELECT cf, trim(coalesce(tel, '')) AS tel FROM comp")
def _(t: Tables):
    return t.comp.select("cf", trim_or_empty(F.col("tel")).alias("tel"))


#: Locale amount parser in SQL.
AMOUNT = r"""
CASE WHEN regexp_matches({0}, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')
     THEN CAST({0} AS DOUBLE) ELSE 0.0 END"""
AMOUNT_TEXT = """
CASE WHEN NOT contains({0}, ',') THEN {0}
     WHEN contains({0}, '.') AND strpos(reverse({0}), '.') < strpos(reverse({0}), ',')
       THEN replace({0}, ',', '')
     ELSE replace(replace({0}, '.', ''), ',', '.') END"""


def amount_sql(column: str) -> str:
    value = f"replace(trim(coalesce({column}, '')), ' ', '')"
    return AMOUNT.format("(" + AMOUNT_TEXT.format(value) + ")")


@query("F17_parse_amount", f"SELECT rea, {amount_sql('ricavi_delle_vendite')} AS amount FROM fin")
def _(t: Tables):
    return t.fin.select("rea", parse_amount(F.col("ricavi_delle_vendite")).alias("amount"))


def bad_cells_sql() -> str:
    """Semicolon-joined names of the cells that do not convert."""
    tests = []
    for name, kind, column in config.FINANCIAL_SCHEMA:
        quoted = name.replace("'", "''")
        if kind == "int":
            tests.append(f"CASE WHEN regexp_matches(trim({column}), '^[+-]?[0-9]+$') THEN NULL "
                         f"ELSE '{quoted}' END")
        elif kind == "float":
            tests.append(
                f"CASE WHEN trim({column}) = '' OR regexp_matches(trim({column}), "
                r"'^[+-]?([0-9]+[.,]?[0-9]*|[.,][0-9]+)([eE][+-]?[0-9]+)?$') THEN NULL "
                f"ELSE '{quoted}' END")
    return "concat_ws(';', " + ", ".join(tests) + ")"


@query("F18_checked_cast", f"""
SELECT o_orderkey, {bad_cells_sql()} AS bad_columns,
       TRY_CAST(trim(rea) AS BIGINT) AS rea,
       TRY_CAST(replace(trim(ricavi_delle_vendite), ',', '.') AS DOUBLE) AS ricavi_delle_vendite
FROM fin_raw""")
def _(t: Tables):
    return financial.check_cells(t.fin_raw).select(
        "o_orderkey", F.concat_ws(";", "bad_columns").alias("bad_columns"), "rea",
        "ricavi_delle_vendite",
    )


@query("F19_year_text", "SELECT projectID, substr(startDate, 1, 4) AS year FROM proj")
def _(t: Tables):
    return t.proj.select("projectID", year_text(F.col("startDate")).alias("year"))


@query("F20_round", """
SELECT k, CAST(round(p, 1) AS DOUBLE) AS one, CAST(round(p, 2) AS DOUBLE) AS two FROM
 (SELECT CAST(o_orderkey AS BIGINT) AS k,
         CAST(CAST(o_totalprice / 7 AS VARCHAR) AS DECIMAL(38, 15)) AS p FROM orders)""")
def _(t: Tables):
    part = F.col("o_totalprice") / 7
    return t.orders.select(
        F.col("o_orderkey").alias("k"), F.round(part, 1).alias("one"), F.round(part, 2).alias("two")
    )


@query("F21_null_handling", """
SELECT cf, nullif(comune, 'NATION_3') AS comune, CASE WHEN prov <> 'NA' THEN prov END AS prov,
       CASE WHEN trim(tel) = '' THEN 'none' ELSE trim(tel) END AS tel FROM comp""")
def _(t: Tables):
    tel = trim_or_empty(F.col("tel"))
    return t.comp.select(
        "cf", F.nullif("comune", F.lit("NATION_3")).alias("comune"),
        null_when_token(F.col("prov")).alias("prov"),
        F.when(tel == "", F.lit("none")).otherwise(tel).alias("tel"),
    )


@query("F22_digests", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def _(t: Tables):
    both = digest(F.col("text").cast("binary"))
    return t.documents.select("doc_id", *[c.alias(n) for n, c in both.items()])


@query("F24_regex_capture", r"""
SELECT page_id, regexp_extract(url, '([a-z]{2})/([0-9]+)', 1) AS lang,
       regexp_extract(url, '([a-z]{2})/([0-9]+)', 2) AS number FROM pages""")
def _(t: Tables):
    pattern = "([a-z]{2})/([0-9]+)"
    return t.pages.select(
        "page_id", F.regexp_extract("url", pattern, 1).alias("lang"),
        F.regexp_extract("url", pattern, 2).alias("number"),
    )


@query("F25_contains_ignoring_case",
       "SELECT doc_id FROM documents WHERE contains(lower(text), lower('TheR'))")
def _(t: Tables):
    return t.documents.filter(contains_ignoring_case(F.col("text"), "TheR")).select("doc_id")


@query("A5_funnel_counts", """
SELECT 'rows' AS step, 1::BIGINT AS position, count(*) AS n_rows FROM org_raw
UNION ALL SELECT 'country', 2, count(*) FROM org_raw WHERE country = 'IT'
UNION ALL SELECT 'has_vat', 3, count(*) FROM org_raw WHERE country = 'IT'
  AND vatNumber NOT IN ('MISSING','NOTAPPLICABLE','VATEXEMPTION') AND vatNumber <> ''
UNION ALL SELECT 'vat_length', 4, count(*) FROM org_raw WHERE country = 'IT'
  AND vatNumber NOT IN ('MISSING','NOTAPPLICABLE','VATEXEMPTION') AND length(vatNumber) = 13""")
def _(t: Tables):
    vat = F.col("vatNumber")
    return funnel(t.org_raw, {
        "rows": F.lit(True),
        "country": F.col("country") == "IT",
        "has_vat": ~vat.isin(config.NO_VAT) & (vat != ""),
        "vat_length": F.length(strip_country_prefix(vat)) == config.VAT_DIGITS,
    })
