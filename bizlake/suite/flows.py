"""The four batch flows over the domain bindings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import config
from ..operators.order import number_rows
from ..plans import financial, participation, registry, serving
from ..plans.loading import published_tables
from ..plans.merging import merge_statements, statements
from ..session import fresh_path
from ..sources.delimited import read_delimited
from ..sources.sinks import with_decimal_commas, write_delimited
from .base import Tables, query
from .bindings import BINDINGS, LINE_ORDER, LINE_ORDER_SQL
from .columns import AS_OF, REPAIRED, SCRUBBED, STRIPPED, bad_cells_sql
from .joins import VAT_DIM, vat_dimension
from .rankings import KEY

SNAPSHOT = "06_2024"


# --- registry -------------------------------------------------------------------
def _sites_built(t: Tables) -> DataFrame:
    """The cleaned registry sheet; lines are numbered first, as a file scan would.

    Numbering writes the lines: only the columns of the sheet.
    """
    used = set(re.findall(r"\bl_\w+", BINDINGS["reg"]))
    lines = number_rows(t.lineitem.select(*[c for c in t.lineitem.columns if c in used]), LINE_ORDER, "row_id")
    text = BINDINGS["reg"].replace("FROM {lineitem}", ", row_id FROM {lineitem}")
    raw = t.spark.sql(text, lineitem=lines).drop(*LINE_ORDER)
    return registry.build_sites(raw, SNAPSHOT, AS_OF)


def _site_export(t: Tables, name: str) -> DataFrame:
    return registry.site_exports(_sites_built(t))[name]


def _activity_export(t: Tables, name: str) -> DataFrame:
    codes = t.codes.drop(*LINE_ORDER)
    activities = registry.build_activities(codes, _sites_built(t), SNAPSHOT)
    return registry.activity_exports(activities)[name].select(*CODE_COLUMNS)


DAYS = ["data_isc_ri", "data_cost", "data_canc", "data_fall", "data_cess_att"]
SITES_CTE = f"""
WITH e1_pos AS (
  SELECT *, row_number() OVER (ORDER BY {LINE_ORDER_SQL}) AS id_localiz FROM reg),
e1_ids AS (
  SELECT cf, row_number() OVER (ORDER BY f) AS id_impresa
  FROM (SELECT cf, min(id_localiz) AS f FROM e1_pos GROUP BY cf)),
e1_sites AS (
  SELECT *, least({', '.join(f'{d}_day' for d in DAYS)}) AS min_date FROM (
    SELECT p.*, id_impresa, count(*) OVER (PARTITION BY p.cf, sede_ul) AS n_same,
           {', '.join(f"CAST({REPAIRED.format(d)} AS DATE) AS {d}_day" for d in DAYS)},
           {SCRUBBED.format('denominazione')} AS nome,
           {KEY.replace('cf ||', 'p.cf ||')} AS key_cfl
    FROM e1_pos p JOIN e1_ids i ON p.cf = i.cf
    WHERE p.cf IN (SELECT cf FROM reg WHERE sede_ul = 'SEDE'))
  WHERE NOT (n_same > 1 AND prov <> prov_camera_commercio)),
e1_codes AS (
  SELECT c.cf, c.rea, c.prov, c.loc_n, ateco_tipo, ateco, ateco_desc, id_impresa, id_localiz,
         s.key_cfl, 'I' AS fonte, '{SNAPSHOT}' AS mm_aaaa
  FROM codes c JOIN e1_sites s ON c.cf || '_' || c.loc_n = s.key_cfl)
"""
SITE_OUT = f"""
SELECT cf, piva, rea, sede_ul, prov, nome AS denominazione, key_cfl, 'I' AS fonte,
       '{SNAPSHOT}' AS mm_aaaa, id_localiz, id_impresa,
       {', '.join(f'CAST({d}_day AS VARCHAR) AS {d}' for d in DAYS)},
       CAST(min_date AS VARCHAR) AS min_date,
       round((DATE '{AS_OF}' - min_date) / 365.0, 6) AS anni,
       CASE WHEN sede_ul = 'SEDE' THEN 's' ELSE 'u' END AS "SEDE_UL_num" """
SITE_COLUMNS = [
    "cf", "piva", "rea", "sede_ul", "prov", "denominazione", "key_cfl", "fonte", "mm_aaaa",
    "id_localiz", "id_impresa", *DAYS, "min_date", "SEDE_UL_num",
]
CODE_COLUMNS = [
    "cf", "rea", "prov", "loc_n", "ateco_tipo", "ateco", "ateco_desc", "id_impresa", "id_localiz",
    "key_cfl", "fonte", "mm_aaaa",
]
CODE_OUT = "SELECT * FROM e1_codes"


def _sites(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        *[F.col(c).cast("string").alias(c) if c in (*DAYS, "min_date") else F.col(c)
          for c in SITE_COLUMNS],
        F.round("anni", 6).alias("anni"), *more,
    )


@query("E1_registry", SITES_CTE + SITE_OUT + "FROM e1_sites")
def _(t: Tables):
    return _sites(_site_export(t, "registry"))


@query("E1_repository_registry", SITES_CTE + SITE_OUT + """,
tipo_sedeul_1 || tipo_sedeul_2 || tipo_sedeul_3 || tipo_sedeul_4 || tipo_sedeul_5 AS tipo_sedeul
FROM e1_sites""")
def _(t: Tables):
    return _sites(_site_export(t, "repository_registry"), "tipo_sedeul")


@query("E1_headquarters", SITES_CTE + SITE_OUT + f"""
FROM (SELECT *, row_number() OVER (PARTITION BY cf ORDER BY
        greatest(data_isc_ri_day, data_cess_att_day, data_fall_day, data_cost_day, data_canc_day)
        DESC NULLS LAST, CASE WHEN data_canc_day IS NULL THEN 0 ELSE 1 END, nome DESC, prov, rea,
        id_localiz) AS rn FROM e1_sites WHERE sede_ul = 'SEDE') WHERE rn = 1""")
def _(t: Tables):
    return _sites(_site_export(t, "headquarters"))


@query("E1_registry_filtered", SITES_CTE + SITE_OUT + """
FROM e1_sites WHERE sede_ul = 'SEDE' OR prov IN ('GO','PN','UD','TS')""")
def _(t: Tables):
    return _sites(_site_export(t, "registry_filtered"))


@query("E1_repository_activities", SITES_CTE + CODE_OUT)
def _(t: Tables):
    return _activity_export(t, "repository_activities")


@query("E1_activities", SITES_CTE + CODE_OUT)
def _(t: Tables):
    return _activity_export(t, "activities")


@query("E1_headquarters_activities", SITES_CTE + CODE_OUT + " WHERE loc_n = '0'")
def _(t: Tables):
    return _activity_export(t, "headquarters_activities")


@query("E1_activities_filtered",
       SITES_CTE + CODE_OUT + " WHERE loc_n = '0' OR prov IN ('GO','PN','UD','TS')")
def _(t: Tables):
    return _activity_export(t, "activities_filtered")


# --- participation ----------------------------------------------------------------
def _programmes(t: Tables) -> list[participation.Programme]:
    return [
        participation.Programme(
            organization=t.org_raw.filter(F.col("l_orderkey") % 2 == odd),
            project=t.proj_raw.filter(F.col("id").cast("bigint") % 2 == odd),
            topics=t.voc.filter(F.col("l_orderkey") % 2 == odd),
            blank_level_falls_back=bool(odd),
        )
        for odd in (0, 1)
    ]


E2 = f"""
WITH dim AS ({VAT_DIM}),
it AS (SELECT o.*, substr(vatNumber, 3) AS vat FROM org_raw o
       WHERE country = 'IT' AND vatNumber NOT IN ('MISSING','NOTAPPLICABLE','VATEXEMPTION')
         AND vatNumber <> '' AND length(substr(vatNumber, 3)) = 11),
c AS (SELECT projectID, string_agg(name, ';' ORDER BY {LINE_ORDER_SQL}) AS coordinator
      FROM org_raw WHERE role = 'coordinator' GROUP BY projectID),
p AS (SELECT projectID, string_agg(name, ';' ORDER BY {LINE_ORDER_SQL}) AS participants
      FROM org_raw WHERE role = 'participant' GROUP BY projectID)
"""


@query("E2_organization", E2 + """
SELECT projectID, vat AS vatNumber, name, country, role, dim.cf,
       replace(ecContribution, '.', ',') AS ecContribution,
       replace(netEcContribution, '.', ',') AS netEcContribution,
       CAST(CAST(try_strptime(contentUpdateDate, ['%Y-%m-%d %H:%M:%S', '%d/%m/%Y']) AS DATE) AS VARCHAR)
       AS contentUpdateDate
FROM it LEFT JOIN dim ON it.vat = dim.piva""")
def _(t: Tables):
    dimension = vat_dimension(t)
    rows = participation.finish_organizations(participation.together([
        participation.build_organization(source, dimension) for source in _programmes(t)
    ])).drop(*LINE_ORDER)
    return rows.withColumn("contentUpdateDate", F.col("contentUpdateDate").cast("string"))


@query("E2_project", E2 + """
SELECT id AS projectID, acronym, CAST(TRY_CAST(startDate AS DATE) AS VARCHAR) AS startDate,
       replace(frameworkProgramme, 'HORIZON', 'HORIZON EUROPE') AS frameworkProgramme,
       coordinator, participants
FROM proj_raw LEFT JOIN c ON c.projectID = id LEFT JOIN p ON p.projectID = id
WHERE id IN (SELECT projectID FROM it)""")
def _(t: Tables):
    rows = participation.run_participation(_programmes(t), vat_dimension(t), LINE_ORDER)["project"]
    return rows.withColumn("startDate", F.col("startDate").cast("string"))


@query("E2_topics", E2 + """
SELECT projectID, euroSciVocTitle, euroSciVocPath, euroSciVocCode,
       string_split(euroSciVocPath, '/')[2] AS livello_1,
       CASE WHEN l_orderkey % 2 = 0
            THEN coalesce(string_split(euroSciVocPath, '/')[3], string_split(euroSciVocPath, '/')[2])
            ELSE coalesce(nullif(string_split(euroSciVocPath, '/')[3], ''),
                          string_split(euroSciVocPath, '/')[2]) END AS livello_2
FROM voc WHERE projectID IN (SELECT projectID FROM it)""")
def _(t: Tables):
    return participation.together([
        participation.build_topics(source, participation.counted_projects(source))
        for source in _programmes(t)
    ]).drop(*LINE_ORDER)


# --- financial --------------------------------------------------------------------
def _financial_input(t: Tables, current: bool) -> DataFrame:
    rows = t.fin_raw.filter((F.col("o_orderstatus") == "P") == current)
    return rows.select(*config.FINANCIAL_COLUMNS, F.col("o_orderkey").alias("row_id"))


def _previous_statements(t: Tables) -> DataFrame:
    """What an earlier run wrote, read back."""
    earlier = financial.run_financial(_financial_input(t, False))["valid"]
    path = fresh_path(t.spark, "statements")
    write_delimited(with_decimal_commas(earlier), path)
    return read_delimited(t.spark, path, "|", blanks="keep")


def _typed_cells() -> str:
    out = []
    for _, kind, column in config.FINANCIAL_SCHEMA:
        if kind == "string":
            out.append(f"nullif({column}, '') AS {column}")
        elif kind == "int":
            out.append(f"TRY_CAST(trim({column}) AS BIGINT) AS {column}")
        else:
            out.append(f"TRY_CAST(replace(trim({column}), ',', '.') AS DOUBLE) AS {column}")
    return ", ".join(out)


CHECKED = f"""
WITH checked AS (SELECT *, {bad_cells_sql()} AS bad FROM fin_raw),
cur AS (SELECT {_typed_cells()} FROM checked WHERE o_orderstatus = 'P' AND bad = ''),
prev AS (SELECT {_typed_cells()} FROM checked WHERE o_orderstatus <> 'P' AND bad = '')
"""


@query("E3_valid", CHECKED + """
SELECT * FROM cur UNION ALL
(SELECT DISTINCT * FROM prev WHERE trim(cf) NOT IN (SELECT trim(cf) FROM cur))""")
def _(t: Tables):
    return financial.run_financial(_financial_input(t, True), _previous_statements(t))["valid"]


@query("E3_merged_by_bucket", CHECKED + """
SELECT * FROM cur UNION ALL
(SELECT DISTINCT * FROM prev WHERE trim(cf) NOT IN (SELECT trim(cf) FROM cur))""")
def _(t: Tables):
    """Two deliveries, one after the other, into the same store."""
    root = fresh_path(t.spark, "statements")
    for now in (False, True):
        valid = financial.run_financial(_financial_input(t, now))["valid"]
        merge_statements(valid, root)
    return statements(t.spark, root, valid.schema)


@query("E3_errors", CHECKED + """
SELECT o_orderkey + 1 AS riga, 'cannot convert: ' || string_split(bad, ';')[1] AS errore,
       bad AS bad_columns
FROM checked WHERE o_orderstatus = 'P' AND bad <> ''""")
def _(t: Tables):
    return financial.run_financial(_financial_input(t, True))["errors"]


# --- serving ----------------------------------------------------------------------
#: Children without a parent: their key is no key of the parent table.
ORPHANS = {
    "fin": ("cf", "CASE WHEN anno = '1995' THEN 'X' || cf ELSE cf END"),
    "org": ("projectID", "CASE WHEN role = 'thirdParty' THEN 'X' || projectID ELSE projectID END"),
    "voc": ("projectID", "CASE WHEN euroSciVocTitle = '' THEN 'X' || projectID ELSE projectID END"),
}


def _with_orphans(t: Tables, name: str) -> DataFrame:
    key, value = ORPHANS[name]
    return getattr(t, name).withColumn(key, F.expr(value))


def _serving_sources(t: Tables) -> dict[str, DataFrame]:
    line = F.struct(*LINE_ORDER).alias("row_id")
    return {
        "headquarters": t.comp,
        "registry": t.sites.select("*", line),
        "financial": _with_orphans(t, "fin"),
        "project": t.proj.withColumn("row_id", F.lit(1)),
        "organization": _with_orphans(t, "org").select("*", line),
        "topics": _with_orphans(t, "voc").select("*", line),
    }


def _run_serving(t: Tables) -> dict[str, DataFrame]:
    return serving.build_serving(_serving_sources(t))


E4 = "WITH hq AS (SELECT cf FROM comp), pr AS (SELECT * FROM proj),\n" + ",\n".join(
    f"{name}_load AS (SELECT * REPLACE ({value} AS {key}) FROM {name})"
    for name, (key, value) in ORPHANS.items()
) + "\n"


def _texts(columns: list[str], present: str, null: str = "") -> str:
    have = present.split()
    return ", ".join(
        f'nullif({STRIPPED.format(c)}, \'\') AS "{c}"' if c == null
        else f'{STRIPPED.format(c)} AS "{c}"' if c in have else f"'' AS \"{c}\""
        for c in columns
    )


@query("E4_load_counts", E4 + """
SELECT 'financial' AS table_name, count(*) FILTER (cf IN (SELECT cf FROM hq)) AS loaded,
       count(*) FILTER (cf NOT IN (SELECT cf FROM hq)) AS skipped FROM fin_load
UNION ALL SELECT 'organization', count(*) FILTER (projectID IN (SELECT projectID FROM pr)),
       count(*) FILTER (projectID NOT IN (SELECT projectID FROM pr)) FROM org_load
UNION ALL SELECT 'topics', count(*) FILTER (projectID IN (SELECT projectID FROM pr)),
       count(*) FILTER (projectID NOT IN (SELECT projectID FROM pr)) FROM voc_load""")
def _(t: Tables):
    """Counted while the child tables are written."""
    children = ["financial", "organization", "topics"]
    load = serving.load_serving(_serving_sources(t), fresh_path(t.spark, "serving"), tables=children)
    return load.report(*children)


@query("E4_published_tables", E4 + """
SELECT 'headquarters' AS table_name, count(*) AS n_rows, count(DISTINCT cf) AS n_keys FROM hq
UNION ALL SELECT 'registry', count(*), count(DISTINCT cf) FROM sites
UNION ALL SELECT 'project', count(*), count(DISTINCT projectID) FROM pr
UNION ALL SELECT 'financial', count(*), count(DISTINCT cf) FROM fin_load WHERE cf IN (SELECT cf FROM hq)
UNION ALL SELECT 'organization', count(*), count(DISTINCT projectID) FROM org_load
          WHERE projectID IN (SELECT projectID FROM pr)
UNION ALL SELECT 'topics', count(*), count(DISTINCT projectID) FROM voc_load
          WHERE projectID IN (SELECT projectID FROM pr)""")
def _(t: Tables):
    """All six tables loaded, published and read as a reader finds them."""
    root = fresh_path(t.spark, "serving")
    load = serving.load_serving(_serving_sources(t), root)
    load.check("headquarters", "project")
    load.publish()
    found = published_tables(t.spark, root, serving.TABLES)
    sizes = [
        df.agg(F.count("*").alias("n_rows"), F.count_distinct("cf" if name in ("headquarters", "registry", "financial") else "projectID").alias("n_keys"))
        .select(F.lit(name).alias("table_name"), "n_rows", "n_keys")
        for name, df in found.items()
    ]
    return reduce(DataFrame.unionByName, sizes)


@query("E4_headquarters", "SELECT " + _texts(
    config.COMPANY_COLUMNS, "cf denominazione prov comune tipo_impresa stato_impresa tel rea piva")
    + " FROM comp")
def _(t: Tables):
    return _run_serving(t)["headquarters"]


@query("E4_registry", "SELECT " + _texts(
    config.COMPANY_COLUMNS, "cf prov tipo_impresa stato_impresa denominazione comune") + " FROM sites")
def _(t: Tables):
    return _run_serving(t)["registry"].drop("row_id")


@query("E4_financial", E4 + "SELECT " + _texts(
    config.FINANCIAL_COLUMNS, "cf cia rea anno totale_attivo ricavi_delle_vendite")
    + " FROM fin_load WHERE cf IN (SELECT cf FROM hq)")
def _(t: Tables):
    return _run_serving(t)["financial"]


@query("E4_project", E4 + "SELECT " + _texts(
    config.PROJECT_COLUMNS, "projectID acronym status title startDate frameworkProgramme")
    + " FROM pr")
def _(t: Tables):
    return _run_serving(t)["project"]


@query("E4_organization", E4 + "SELECT " + _texts(
    config.ORGANIZATION_COLUMNS, "projectID organisationID name role ecContribution vatNumber", "cf")
    + " FROM org_load WHERE projectID IN (SELECT projectID FROM pr)")
def _(t: Tables):
    return _run_serving(t)["organization"]


@query("E4_topics", E4 + "SELECT " + _texts(
    config.TOPIC_COLUMNS, "projectID euroSciVocTitle euroSciVocPath euroSciVocCode")
    + " FROM voc_load WHERE projectID IN (SELECT projectID FROM pr)")
def _(t: Tables):
    return _run_serving(t)["topics"]
