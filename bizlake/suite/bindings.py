"""Domain tables bound to the test tables, in SQL that both engines read alike.

``{name}`` stands for a test table or another binding.  All columns that the
domain holds as text are text here.
"""

from __future__ import annotations

#: File order of rows bound to ``lineitem``; unique.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)

#: Amount columns of a financial statement after the four key columns.
AMOUNTS = [
    "totale_attivo", "totale_immobilizzazioni_immateriali",
    "crediti_esigibili_entro_esercizio_successivo", "totale_patrimonio_netto",
    "debiti_esigibili_entro_esercizio_successivo", "totale_valore_della_produzione",
    "ricavi_delle_vendite", "totale_costi_del_personale",
    "differenza_tra_valore_e_costi_della_produzione",
    "ammortamento_immobilizzazione_immateriali", "utile_perdita_esercizio_ultimi",
    "valore_aggiunto", "tot_aam_acc_svalutazioni", "ron_reddito_operativo_netto",
    "immobilizzazioni_materiali", "immobilizzazioni_finanziarie", "attivo_circolante",
]


def _shifted(date: str) -> str:
    return f"CAST(year({date}) + 3000 AS STRING) || substr(CAST({date} AS STRING), 5)"


def _times(k: int) -> str:
    return f"CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * {k} AS DECIMAL(20,2)) AS STRING)"


_SHIP = "CAST(l_shipdate AS DATE)"
_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
_LINE_PRICE = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)"

BINDINGS: dict[str, str] = {
    # registry sheet: one row per order line, the order being the company
    "reg": f"""
SELECT CAST(l_orderkey AS STRING) AS cf,
       lpad(CAST(l_suppkey AS STRING), 11, '0') AS piva,
       CAST(l_partkey AS STRING) AS rea,
       CASE WHEN l_linenumber = 1 THEN 'SEDE'
            ELSE 'UL-' || CAST(l_linenumber AS STRING) END AS sede_ul,
       CASE l_returnflag WHEN 'A' THEN 'UD' WHEN 'N' THEN 'NA' ELSE 'TS' END AS prov,
       CASE l_linestatus WHEN 'F' THEN 'UD' ELSE 'NA' END AS prov_camera_commercio,
       ' Ditta  #' || CAST(l_partkey AS STRING) || ' "' || l_returnflag || '"|*x ' AS denominazione,
       'Attivita -' || l_linestatus || '_x000D_' AS descrizione_attivita,
       'Via' || chr(10) || CAST(l_suppkey AS STRING) || chr(9) AS indirizzo,
       CASE WHEN l_quantity <= 25 THEN 'ATTIVA' ELSE 'CESSATA' END AS stato_impresa,
       CASE WHEN l_suppkey % 9 = 0 THEN ''
            ELSE 'T' || CAST(l_suppkey % 9 AS STRING) END AS tipo_impresa,
       CASE WHEN l_suppkey % 10 = 0 THEN ''
            ELSE 'Comune ' || CAST(l_suppkey % 10 AS STRING) END AS comune,
       l_returnflag AS tipo_sedeul_1, l_linestatus AS tipo_sedeul_2, '' AS tipo_sedeul_3,
       CAST(l_linenumber AS STRING) AS tipo_sedeul_4, '' AS tipo_sedeul_5,
       {_shifted(_SHIP)} AS data_isc_ri,
       {_shifted(f'({_SHIP} - l_linenumber)')} AS data_cost,
       CASE WHEN l_discount > 0.07 THEN {_shifted(f'({_SHIP} + 30)')} ELSE '' END AS data_canc,
       CAST({_SHIP} AS STRING) AS data_fall,
       CASE WHEN l_tax > 0.06 THEN '1799-03-01' ELSE 'x' END AS data_cess_att,
       {LINE_ORDER_SQL}
FROM {{lineitem}}""",
    # activity codes: several per site
    "codes": f"""
SELECT CAST(l_orderkey AS STRING) AS cf, CAST(l_partkey AS STRING) AS rea,
       CASE l_returnflag WHEN 'A' THEN 'UD' WHEN 'N' THEN 'NA' ELSE 'TS' END AS prov,
       CASE WHEN l_linenumber = 1 THEN '0' ELSE CAST(l_linenumber AS STRING) END AS loc_n,
       CASE WHEN l_linestatus = 'F' THEN 'I' ELSE 'P' END AS ateco_tipo,
       CAST(l_suppkey AS STRING) AS ateco, 'Codice ' || l_returnflag AS ateco_desc,
       {LINE_ORDER_SQL}
FROM {{lineitem}}""",
    # companies with headquarters
    "comp": """
SELECT CAST(c_custkey AS STRING) AS cf, c_name AS denominazione,
       CASE c_nationkey % 5 WHEN 0 THEN 'UD' WHEN 1 THEN 'TS' WHEN 2 THEN 'GO'
            WHEN 3 THEN 'PN' ELSE 'NA' END AS prov,
       n_name AS comune, c_mktsegment AS tipo_impresa,
       CASE WHEN c_acctbal > 0 THEN 'ATTIVA' ELSE 'CESSATA' END AS stato_impresa,
       CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE 'tel ' || CAST(c_custkey AS STRING) || '  ' END AS tel,
       CAST(c_custkey AS STRING) AS rea, lpad(CAST(c_custkey AS STRING), 11, '0') AS piva,
       c_custkey AS row_id
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    # serving rows of the registry: many sites per company
    "sites": f"""
SELECT CAST(l_partkey AS STRING) AS cf,
       CASE l_suppkey % 5 WHEN 0 THEN 'UD' WHEN 1 THEN 'TS' WHEN 2 THEN 'GO'
            WHEN 3 THEN 'PN' ELSE 'MI' END AS prov,
       CASE WHEN l_suppkey % 9 = 0 THEN ''
            ELSE 'T' || CAST(l_suppkey % 9 AS STRING) END AS tipo_impresa,
       CASE WHEN l_quantity <= 25 THEN 'ATTIVA' ELSE 'CESSATA' END AS stato_impresa,
       CASE WHEN l_linenumber % 3 = 0 THEN ''
            ELSE 'Ditta ' || CAST(l_partkey AS STRING) || '/' || CAST(l_suppkey AS STRING) END
            AS denominazione,
       CASE WHEN l_suppkey % 10 = 0 THEN ''
            ELSE 'Comune ' || CAST(l_suppkey % 10 AS STRING) END AS comune,
       {LINE_ORDER_SQL}
FROM {{lineitem}}""",
    # financial statements, amounts in several notations
    "fin": f"""
SELECT CAST(o_custkey AS STRING) AS cf, o_orderpriority AS cia,
       CAST(o_orderkey AS STRING) AS rea,
       CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE CAST(year(o_orderdate) AS STRING) END AS anno,
       {_times(3)} AS totale_attivo,
       CASE WHEN o_orderkey % 53 = 0 THEN 'abc'
            WHEN o_orderkey % 59 = 0 THEN ''
            WHEN o_orderkey % 4 = 0 THEN {_PRICE}
            WHEN o_orderkey % 4 = 1 THEN ' ' || replace({_PRICE}, '.', ',')
            WHEN length({_PRICE}) <= 6 THEN {_PRICE}
            WHEN o_orderkey % 4 = 2 THEN
              substr({_PRICE}, 1, length({_PRICE}) - 6) || '.' ||
              substr({_PRICE}, length({_PRICE}) - 5, 3) || ',' ||
              substr({_PRICE}, length({_PRICE}) - 1)
            ELSE substr({_PRICE}, 1, length({_PRICE}) - 6) || ',' ||
              substr({_PRICE}, length({_PRICE}) - 5) END AS ricavi_delle_vendite
FROM {{orders}}""",
    # raw financial file: 21 text columns with decimal commas and some bad cells
    "fin_raw": f"""
SELECT CASE WHEN o_orderkey % 37 = 0 THEN ' ' || lpad(CAST(o_custkey AS STRING), 6, '0') || ' '
            ELSE lpad(CAST(o_custkey AS STRING), 6, '0') END AS cf,
       CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE o_orderpriority END AS cia,
       CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE lpad(CAST(o_orderkey AS STRING), 9, '0') END AS rea,
       CAST(year(o_orderdate) AS STRING) AS anno,
       {', '.join(
           f"CASE WHEN o_orderkey % {47 + 2 * k} = 0 THEN 'abc' "
           f"WHEN o_orderkey % {48 + k} = 0 THEN '' "
           f"ELSE replace({_times(k)}, '.', ',') END AS {name}"
           for k, name in enumerate(AMOUNTS, 1))},
       o_orderkey, o_orderstatus
FROM {{orders}}""",
    # projects as loaded
    "proj": """
SELECT CAST(o_orderkey AS STRING) AS projectID, 'ACR' || CAST(o_custkey AS STRING) AS acronym,
       o_orderpriority AS status, 'Project of ' || CAST(o_custkey AS STRING) AS title,
       CASE WHEN o_orderkey % 61 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END
            AS startDate,
       CASE o_orderstatus WHEN 'F' THEN 'H2020' WHEN 'O' THEN 'HORIZON EUROPE' ELSE 'OTHER' END
            AS frameworkProgramme
FROM {orders}""",
    # organisations as loaded: the tax code is null where the company is unknown
    "org": f"""
SELECT CAST(l_orderkey AS STRING) AS projectID,
       CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(l_suppkey AS STRING) END AS cf,
       CAST(l_partkey AS STRING) AS organisationID,
       'Supplier ' || CAST(l_suppkey AS STRING) AS name,
       CASE WHEN l_linenumber = 1 THEN 'coordinator' WHEN l_linenumber < 6 THEN 'participant'
            ELSE 'thirdParty' END AS role,
       replace({_LINE_PRICE}, '.', ',') AS ecContribution,
       'IT' || lpad(CAST(l_suppkey AS STRING), 11, '0') AS vatNumber,
       {LINE_ORDER_SQL}
FROM {{lineitem}}""",
    # topics of projects
    "voc": f"""
SELECT CAST(l_orderkey AS STRING) AS projectID,
       CASE WHEN l_partkey % 13 = 0 THEN '' ELSE p_type END AS euroSciVocTitle,
       CASE WHEN l_partkey % 11 = 0 THEN '/' || p_type
            WHEN l_partkey % 12 = 0 THEN '/' || p_type || '/'
            WHEN l_partkey % 17 = 0 THEN NULL
            ELSE '/' || p_type || '/' || p_brand || '/' || p_name END AS euroSciVocPath,
       p_brand AS euroSciVocCode, {LINE_ORDER_SQL}
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    # raw organisations of both programmes
    "org_raw": f"""
SELECT CAST(l_orderkey AS STRING) AS projectID,
       CASE WHEN l_partkey % 19 = 0 THEN 'MISSING' WHEN l_partkey % 23 = 0 THEN NULL
            WHEN l_partkey % 29 = 0 THEN 'NOTAPPLICABLE' WHEN l_partkey % 31 = 0 THEN ''
            WHEN l_partkey % 37 = 0 THEN 'IT123'
            ELSE 'IT' || lpad(CAST(l_suppkey AS STRING), 11, '0') END AS vatNumber,
       'Supplier ' || CAST(l_suppkey AS STRING) AS name,
       CASE WHEN l_returnflag = 'R' THEN 'DE' ELSE 'IT' END AS country,
       CASE WHEN l_linenumber = 1 THEN 'coordinator' WHEN l_linenumber < 6 THEN 'participant'
            ELSE 'thirdParty' END AS role,
       {_LINE_PRICE} AS ecContribution, {_LINE_PRICE} AS netEcContribution,
       CASE WHEN l_linenumber % 2 = 0 THEN CAST({_SHIP} AS STRING) || ' 10:20:30'
            ELSE substr(CAST({_SHIP} AS STRING), 9, 2) || '/' || substr(CAST({_SHIP} AS STRING), 6, 2)
                 || '/' || substr(CAST({_SHIP} AS STRING), 1, 4) END AS contentUpdateDate,
       {LINE_ORDER_SQL}
FROM {{lineitem}}""",
    "proj_raw": """
SELECT CAST(o_orderkey AS STRING) AS id, 'ACR' || CAST(o_custkey AS STRING) AS acronym,
       CASE WHEN o_orderkey % 71 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END
            AS startDate,
       CASE o_orderstatus WHEN 'F' THEN 'H2020' WHEN 'O' THEN 'HORIZON' ELSE 'OTHER' END
            AS frameworkProgramme
FROM {orders}""",
}
