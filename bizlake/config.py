"""Column sets, code lists and layouts of the three domains."""

from __future__ import annotations

# --- fixed values: code lists -------------------------------------------------
HOME_PROVINCES = ["GO", "PN", "UD", "TS"]
HEADQUARTERS = "SEDE"
NO_VAT = ["MISSING", "NOTAPPLICABLE", "VATEXEMPTION"]
VAT_DIGITS = 11
PROGRAMMES = ["H2020", "HORIZON EUROPE"]
UNCLASSIFIED_TOPIC = "Non classificato"
ACTIVE = "ATTIVA"
WORKBOOK_SHEETS = ["FRIULI Anagrafica", "FRIULI codice attività"]

# --- fixed values: text that a CSV reader takes as missing ---------------------
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: registry columns -------------------------------------------
REGISTRY_TEXT_COLUMNS = ["denominazione", "descrizione_attivita", "indirizzo"]
HEADQUARTERS_DATE_COLUMNS = [
    "data_isc_ri", "data_isc_rd", "data_ini_at", "data_cess_att", "data_fall",
    "data_liquid", "data_fine_aa", "data_cost", "data_canc",
]
SITE_CLASS_COLUMNS = [
    "tipo_sedeul_1", "tipo_sedeul_2", "tipo_sedeul_3", "tipo_sedeul_4", "tipo_sedeul_5",
]
COMPANY_COLUMNS = [
    "cf", "prov", "reg_imp_n", "rea", "sede_ul", "tipo_impresa", "n-albo_art",
    "denominazione", "indirizzo", "indirizzo_strad", "indirizzo_cap", "comune",
    "indirizzo_fraz", "indirizzo_altre", "addetti_aaaa", "addetti_indip",
    "addetti_dip", "piva", "tel", "capitale", "descrizione_attivita",
    "capitale_valuta", "stato_impresa", "tipo_sedeul_1", "tipo_sedeul_2",
    "tipo_sedeul_3", "tipo_sedeul_4", "tipo_sedeul_5", "imp_sedi_ee",
    "imp_eefvg", "imp_pmi", "imp_startup", "imp_femmilile", "imp_giovanile",
    "imp_straniera", "PEC", "data_fine_aa", "data_cost", "tipo_localizzazione",
]
ACTIVITY_COLUMNS = ["cf", "rea", "prov", "loc_n", "ateco_tipo", "ateco", "ateco_desc"]

# --- fixed values: financial statement, (file name, type, table name) ----------
FINANCIAL_SCHEMA = [
    ("c fiscale", "string", "cf"),
    ("cia", "string", "cia"),
    ("rea", "int", "rea"),
    ("anno", "int", "anno"),
    ("Totale attivo", "float", "totale_attivo"),
    ("Totale Immobilizzazioni immateriali", "float", "totale_immobilizzazioni_immateriali"),
    ("Crediti esigibili entro l'esercizio successivo", "float",
     "crediti_esigibili_entro_esercizio_successivo"),
    ("Totale patrimonio netto", "float", "totale_patrimonio_netto"),
    ("Debiti esigibili entro l'esercizio successivo", "float",
     "debiti_esigibili_entro_esercizio_successivo"),
    ("Totale valore della produzione", "float", "totale_valore_della_produzione"),
    ("Ricavi delle vendite", "float", "ricavi_delle_vendite"),
    ("Totale Costi del Personale", "float", "totale_costi_del_personale"),
    ("Differenza tra valore e costi della produzione", "float",
     "differenza_tra_valore_e_costi_della_produzione"),
    ("Ammortamento Immobilizzazione Immateriali", "float",
     "ammortamento_immobilizzazione_immateriali"),
    ("Utile/perdita esercizio ultimi", "float", "utile_perdita_esercizio_ultimi"),
    ("valore aggiunto", "float", "valore_aggiunto"),
    ("tot.aam.acc.svalutazioni", "float", "tot_aam_acc_svalutazioni"),
    ("(ron) reddito operativo netto", "float", "ron_reddito_operativo_netto"),
    ("Immobilizzazioni materiali", "float", "immobilizzazioni_materiali"),
    ("Immobilizzazioni finanziarie", "float", "immobilizzazioni_finanziarie"),
    ("Attivo Circolante", "float", "attivo_circolante"),
]
FINANCIAL_COLUMNS = [safe for _, _, safe in FINANCIAL_SCHEMA]
FINANCIAL_FILE_NAMES = {safe: name for name, _, safe in FINANCIAL_SCHEMA}

# --- fixed values: project participation columns -------------------------------
ORGANIZATION_COLUMNS = [
    "projectID", "cf", "projectAcronym", "organisationID", "vatNumber", "name",
    "shortName", "SME", "activityType", "street", "postCode", "city", "country",
    "nutsCode", "geolocation", "organizationURL", "contactForm",
    "contentUpdateDate", "rcn", "order", "role", "ecContribution",
    "netEcContribution", "totalCost", "endOfParticipation", "active",
]
PROJECT_COLUMNS = [
    "projectID", "acronym", "status", "title", "startDate", "endDate",
    "totalCost", "ecMaxContribution", "legalBasis", "topics", "ecSignatureDate",
    "frameworkProgramme", "masterCall", "subCall", "fundingScheme", "objective",
    "contentUpdateDate", "rcn", "grantDoi", "keywords", "coordinator",
    "participants",
]
TOPIC_COLUMNS = [
    "projectID", "euroSciVocCode", "euroSciVocPath", "euroSciVocTitle",
    "euroSciVocDescription", "livello_1", "livello_2",
]
PROJECT_DATE_COLUMNS = ["startDate", "endDate", "ecSignatureDate", "contentUpdateDate"]

# --- fixed values: limits the reports apply -----------------------------------
LEGAL_FORMS_SHOWN = 6
RANKING_SHOWN = 20
COMPANIES_SHOWN = 300
CHILDREN_SHOWN = 10

#: Most values one joined-name cell may hold; longer groups continue in further rows.
NAMES_PER_CELL = 50_000
