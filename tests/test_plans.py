"""The four flows and the reports on a small hand-written dataset."""

import datetime as dt

import pytest

from bizlake import config
from bizlake.plans import catalogue, dashboards, financial, participation, registry, serving
from bizlake.sources.delimited import ColumnCountError

AS_OF = dt.date(2024, 6, 30)

SITE_DEFAULTS = {
    "piva": "", "rea": "1", "prov": "UD", "prov_camera_commercio": "UD", "denominazione": "Ditta",
    "descrizione_attivita": "", "indirizzo": "", "tipo_sedeul_1": "a", "tipo_sedeul_2": "",
    "tipo_sedeul_3": "c", "tipo_sedeul_4": "", "tipo_sedeul_5": "", "data_isc_ri": "",
    "data_cost": "", "data_canc": "",
}


def sites(spark, *rows):
    filled = [{**SITE_DEFAULTS, "row_id": i, **row} for i, row in enumerate(rows, 1)]
    columns = ["cf", "sede_ul", *SITE_DEFAULTS, "row_id"]
    schema = ", ".join(f"{c} {'long' if c == 'row_id' else 'string'}" for c in columns)
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in filled], schema)


@pytest.fixture(scope="module")
def exports(spark):
    raw = sites(
        spark,
        {"cf": "B", "sede_ul": "SEDE", "data_isc_ri": "5010-01-01", "denominazione": 'Old "B"'},
        {"cf": "A", "sede_ul": "SEDE", "prov": "NA", "prov_camera_commercio": "NA",
         "data_cost": "4987-03-01", "data_isc_ri": "1987-03-01"},
        {"cf": "B", "sede_ul": "SEDE", "data_isc_ri": "5020-01-01", "denominazione": "New B"},
        {"cf": "A", "sede_ul": "UL-1", "prov": "MI", "prov_camera_commercio": "MI"},
        {"cf": "A", "sede_ul": "UL-2", "prov": "TS", "prov_camera_commercio": "TS"},
        {"cf": "C", "sede_ul": "UL-1"},
        {"cf": "D", "sede_ul": "SEDE"},
        {"cf": "D", "sede_ul": "UL-7", "prov": "UD", "prov_camera_commercio": "GO"},
        {"cf": "D", "sede_ul": "UL-7", "prov": "UD", "prov_camera_commercio": "PN"},
        {"cf": "D", "sede_ul": "UL-8", "prov": "UD", "prov_camera_commercio": "GO"},
    )
    codes = spark.createDataFrame(
        [("A", "1", "NA", "0", "P", "62.01", "x"), ("A", "1", "MI", "1", "P", "62.01", "x"),
         ("A", "1", "TS", "2", "P", "62.01", "x"), ("A", "1", "TS", "9", "P", "62.01", "x"),
         ("C", "1", "UD", "1", "P", "62.01", "x")],
        ", ".join(f"{c} string" for c in config.ACTIVITY_COLUMNS),
    )
    return registry.run_registry(raw, codes, "06_2024", AS_OF)


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_registry_keys_and_duplicates(exports):
    assert values(exports["registry"], "cf", "key_cfl", "id_impresa", "id_localiz") == [
        ("A", "A_0", 2, 2), ("A", "A_1", 2, 4), ("A", "A_2", 2, 5), ("B", "B_0", 1, 1),
        ("B", "B_0", 1, 3), ("D", "D_0", 4, 7), ("D", "D_8", 4, 10),
    ]


def test_registry_dates_and_text(exports):
    rows = {(r.cf, r.id_localiz): r for r in exports["registry"].collect()}
    assert rows["A", 2].data_cost == dt.date(1987, 3, 1) and rows["A", 2].data_isc_ri is None
    assert rows["A", 2].min_date == dt.date(1987, 3, 1) and rows["A", 2].prov == "NA"
    assert rows["B", 1].denominazione == "Old  B" and rows["B", 1].mm_aaaa == "06_2024"
    assert values(exports["repository_registry"].filter("cf = 'D'"), "tipo_sedeul") == [("ac",)] * 2


def test_one_headquarters_per_company_latest_first(exports):
    assert values(exports["headquarters"], "cf", "denominazione") == [
        ("A", "Ditta"), ("B", "New B"), ("D", "Ditta"),
    ]


def test_equal_dates_prefer_the_one_not_cancelled(spark):
    raw = sites(
        spark,
        {"cf": "A", "sede_ul": "SEDE", "data_isc_ri": "5020-01-01", "data_canc": "5010-01-01", "rea": "1"},
        {"cf": "A", "sede_ul": "SEDE", "data_isc_ri": "5020-01-01", "rea": "2"},
    )
    best = registry.best_headquarters(registry.build_sites(raw, "06_2024", AS_OF))
    assert values(best, "rea") == [("2",)]


def test_only_sites_that_stay_are_cleaned(spark):
    raw = sites(spark, {"cf": "A", "sede_ul": "SEDE"}, {"cf": "A", "sede_ul": "UL-2"})
    built = registry.build_sites(raw, "06_2024", AS_OF)
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" in plan and "translate(" not in plan[plan.index("Join") :]


def test_scope_of_filtered_exports(exports):
    assert values(exports["registry_filtered"].filter("cf = 'A'"), "sede_ul") == [("SEDE",), ("UL-2",)]
    assert values(exports["activities"], "cf", "loc_n") == [("A", "0"), ("A", "1"), ("A", "2")]
    assert values(exports["activities_filtered"], "loc_n") == [("0",), ("2",)]
    assert values(exports["headquarters_activities"], "loc_n", "id_localiz") == [("0", 2)]


def test_strict_dates_stop_the_run(spark):
    raw = sites(spark, {"cf": "A", "sede_ul": "SEDE", "data_cost": "4987-02-30"})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        registry.clean_sites(raw, "06_2024", strict=True).collect()
    assert registry.clean_sites(raw, "06_2024").first().data_cost is None


# --- participation ----------------------------------------------------------------
def programme(spark, organizations, projects, topics, blank):
    org = spark.createDataFrame(
        [(*row, i) for i, row in enumerate(organizations)],
        "projectID string, vatNumber string, name string, country string, role string, "
        "ecContribution string, netEcContribution string, contentUpdateDate string, row_id int",
    )
    proj = spark.createDataFrame(projects, "id string, frameworkProgramme string, startDate string")
    voc = spark.createDataFrame(topics, "projectID string, euroSciVocPath string")
    return participation.Programme(org, proj, voc, blank)


def test_participation(spark):
    when = "2022-08-15 16:25:02"
    first = programme(
        spark,
        [("1", "IT01234567890", "Alfa", "IT", "coordinator", "1.5", "2", when),
         ("1", "DE123", "Beta", "DE", "coordinator", "1", "1", when),
         ("1", "IT0123456789", "Short", "IT", "participant", "1", "1", when),
         ("1", None, None, "IT", "participant", "1", "1", when),
         ("2", "MISSING", "Gamma", "IT", "participant", "1", "1", when),
         ("3", "XX99999999999", "Delta", "IT", "thirdParty", "1", "1", "soon")],
        [("1", "H2020", "2020-01-01"), ("2", "H2020", "2020-01-01"), ("3", "H2020", "x")],
        [("1", "/a/"), ("2", "/a/b"), ("3", None)], False,
    )
    second = programme(
        spark, [("1", "IT11111111111", "Eps", "IT", "participant", "1", "1", "15/08/2022")],
        [("1", "HORIZON", "2021-01-01")], [("1", "/a/")], True,
    )
    companies = spark.createDataFrame(
        [("01234567890", "CF1", 1), ("01234567890", "CF2", 2)], "piva string, cf string, at int"
    )
    dimension = participation.vat_dimension(companies, ["at"])
    out = participation.run_participation([first, second], dimension, ["row_id"])
    assert values(out["organization"], "projectID", "vatNumber", "ecContribution") == [
        ("1", "01234567890", "1,5"), ("1", "11111111111", "1"), ("3", "99999999999", "1"),
    ]
    assert out["organization"].filter("cf = 'CF1'").count() == 1
    dates = {r.contentUpdateDate for r in out["organization"].collect()}
    assert dates == {dt.date(2022, 8, 15), None}
    projects = {(r.projectID, r.frameworkProgramme): r for r in out["project"].collect()}
    assert set(projects) == {("1", "H2020"), ("3", "H2020"), ("1", "HORIZON EUROPE")}
    assert projects["1", "H2020"].coordinator == "Alfa;Beta"
    assert projects["1", "H2020"].participants == "Short"
    assert projects["3", "H2020"].startDate is None
    levels = ["-" if r.livello_2 is None else r.livello_2 for r in out["topics"].collect()]
    assert sorted(levels) == ["", "-", "a"]
    assert out["further_names"].count() == 0


# --- financial --------------------------------------------------------------------
def statement(spark, *rows, columns=21):
    names = [name for name, _, _ in config.FINANCIAL_SCHEMA][:columns] + ["more"] * (columns > 21)
    schema = ", ".join(f"`{n}` string" for n in names) + ", row_id long"
    filled = [
        tuple([r.get(i, "1,5") for i in range(columns)] + [at]) for at, r in enumerate(rows, 1)
    ]
    return spark.createDataFrame(filled, schema)


KEYS = {0: "00123", 1: "UD", 2: "0042", 3: "2022"}


def test_statements_are_checked_cell_by_cell(spark):
    raw = statement(
        spark, KEYS, KEYS | {2: ""}, KEYS | {4: "", 5: "1.234"}, KEYS | {4: "abc", 6: "x"},
        KEYS | {1: "", 4: "1.234,5"},
    )
    out = financial.run_financial(raw)
    amounts = {(r.totale_attivo, r.totale_immobilizzazioni_immateriali) for r in out["valid"].collect()}
    assert amounts == {(1.5, 1.5), (None, 1.234)}
    assert values(out["valid"], "cf", "rea", "anno") == [("00123", 42, 2022)] * 2
    errors = {r.riga: r for r in out["errors"].collect()}
    assert set(errors) == {3, 5, 6}
    assert errors[3].bad_columns == "rea"
    assert errors[5].errore.endswith("Totale attivo")
    assert errors[5].bad_columns == "Totale attivo;Crediti esigibili entro l'esercizio successivo"
    assert out["valid"].count() + out["errors"].count() == raw.count()


def test_other_column_counts_are_refused(spark):
    for n in (20, 22):
        with pytest.raises(ColumnCountError):
            financial.run_financial(statement(spark, KEYS, columns=n))


def test_vanished_companies_are_carried_forward_once(spark):
    current = spark.createDataFrame([("\ufeffA ", 1.0)], "cf string, v double")
    previous = spark.createDataFrame(
        [("A", "9,0"), ("B", "2,5"), ("B", "2,5"), (" ", "3,0")], "cf string, v string"
    )
    merged = financial.carry_forward(current, previous)
    assert values(merged, "cf", "v") == [("B", 2.5), ("\ufeffA ", 1.0)]
    assert values(financial.carry_forward(merged, merged), "v") == [(1.0,), (2.5,)]
    assert financial.carry_forward(current, None) is current
    assert financial.carry_forward(current, previous.drop("v")) is current
    empty = current.limit(0)
    assert values(financial.carry_forward(empty, previous), "cf", "v") == [("A", 9.0), ("B", 2.5)]


# --- serving and reports ------------------------------------------------------------
@pytest.fixture(scope="module")
def sources(spark):
    def df(schema, *rows):
        return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", row_id int")

    return {
        "headquarters": df("cf string, prov string", (" A ", "UD"), ("B", "TS"), ("A", "GO"), (" ", "x")),
        "registry": df(
            "cf string, prov string, stato_impresa string, tipo_impresa string, denominazione string, "
            "comune string",
            ("A", "UD", "ATTIVA", "SRL", "", "Udine"), ("A", "TS", "ATTIVA", "SRL", "Alfa\n", "Trieste"),
            ("B", "MI", "ATTIVA", "", "Beta", "Milano"), ("B", "UD", "CESSATA", "SPA", "Beta", ""),
        ),
        "financial": df(
            "cf string, anno string, rea string, ricavi_delle_vendite string",
            ("A", "2021", "1", "1.000,50"), ("A", "2022", "1", "10"), ("B", "2022", "2", "40"),
            ("Z", "2022", "3", "99"), (None, "2022", "3", "99"),
        ),
        "project": df(
            "projectID string, acronym string, frameworkProgramme string, startDate string",
            ("1", "ONE", "H2020", "2020-05-01"), ("2", "TWO", "HORIZON EUROPE", "2021-05-01"),
            ("2", "DUP", "H2020", "2021-05-01"), ("3", "SIX", "FP6", "2003-01-01"),
        ),
        "organization": df(
            "projectID string, cf string, organisationID string, name string, ecContribution string",
            ("1", "A", "o1", "Alfa", "100,5"), ("2", "A", "o1", "Alfa", "50"), ("2", "", "o2", "X", "7"),
            ("3", "B", "o3", "Beta", "1"), ("9", "A", "o1", "Alfa", "1"),
        ),
        "topics": df(
            "projectID string, euroSciVocTitle string, livello_1 string, livello_2 string",
            ("1", "", "a", "b"), ("2", "maths", "a", "c"), ("9", "maths", "a", "c"),
        ),
    }


@pytest.fixture(scope="module")
def tables(sources):
    return serving.build_serving(sources)


def test_serving_tables(tables):
    assert values(tables["headquarters"], "cf", "prov") == [("A", "UD"), ("B", "TS")]
    assert values(tables["project"].filter("projectID = '2'"), "acronym") == [("TWO",)]
    assert tables["organization"].filter("cf is null").count() == 1
    parents = tables["project"].select("projectID")
    assert tables["organization"].join(parents, "projectID", "left_anti").count() == 0


def test_company_reports(tables):
    reg = tables["registry"]
    assert values(dashboards.company_totals(reg), "active_companies", "active_sites") == [(2, 3)]
    assert values(dashboards.legal_forms(reg), "tipo_impresa", "company_count", "pct_of_shown") == [
        ("SRL", 1, 100.0)
    ]
    assert values(dashboards.province_counts(reg), "prov", "bar_width") == [("TS", 100.0), ("UD", 100.0)]
    assert values(dashboards.province_counts(reg, "UD"), "prov") == [("UD",)]


def test_connected_companies(tables):
    args = (tables["headquarters"], tables["registry"], tables["financial"], tables["organization"])
    found = dashboards.connected_companies(*args)
    assert values(
        found, "cf", "rank", "project_count", "financial_count", "latest_financial_year",
        "company_name", "registry_comune",
    ) == [("A", 1, 2, 2, "2022", "Alfa", "Udine"), ("B", 2, 1, 1, "2022", "Beta", "Milano")]
    assert values(dashboards.connected_companies(*args, query="MILAN"), "cf") == [("B",)]
    assert dashboards.connected_companies(*args, query="nowhere").count() == 0


def test_project_reports(tables):
    org, proj = tables["organization"], tables["project"]
    assert values(dashboards.companies_per_start_year(org, proj), "year", "h2020_count", "he_count") == [
        ("2020", 1, 0), ("2021", 0, 1),
    ]
    top = dashboards.top_contributions(org, proj, tables["headquarters"], tables["registry"], ["row_id"])
    assert values(top, "cf", "company_name", "h2020_amount", "he_amount", "total_amount") == [
        ("A", "Alfa", 100.5, 50.0, 150.5)
    ]
    assert values(dashboards.top_topics(tables["topics"], proj), "title", "total_count") == [
        ("Non classificato", 1), ("maths", 1),
    ]
    assert values(dashboards.project_search(proj, org, tables["topics"], "tw"),
                  "projectID", "organization_count", "company_count", "topic_count") == [("2", 2, 1, 1)]


def test_finance_reports(tables):
    fin = tables["financial"]
    assert values(dashboards.revenue_per_year(fin), "anno", "revenue", "bar_width") == [
        ("2021", 1000.5, 100.0), ("2022", 50.0, 5.0),
    ]
    ranking = dashboards.revenue_ranking(fin, tables["headquarters"], tables["registry"], ["row_id"])
    assert values(ranking, "rank", "cf", "company_name") == [(1, "B", "Beta"), (2, "A", "Alfa")]
    chosen = dashboards.revenue_ranking(
        fin, tables["headquarters"], tables["registry"], ["row_id"], year="2021"
    )
    assert values(chosen, "cf", "revenue") == [("A", 1000.5)]


def test_details(tables):
    found = dashboards.company_detail(
        tables["headquarters"], tables["registry"], tables["financial"], tables["organization"]
        .selectExpr("*", "0 as row_id"), tables["project"], ["row_id"], cf="A",
    )
    assert values(found["financial"], "place", "anno") == [(1, "2022"), (2, "2021")]
    assert values(found["projects"], "place", "projectID") == [(1, "1"), (2, "2")]


def test_details_keep_every_row_unless_told(tables):
    financial = tables["financial"].filter("cf = 'A'").limit(1).selectExpr(
        "*", "explode(sequence(1, 25)) as n"
    ).selectExpr("* except (rea, n)", "cast(n as string) as rea")
    organization = tables["organization"].selectExpr("*", "0 as row_id")

    def statements(**options):
        found = dashboards.company_detail(
            tables["headquarters"], tables["registry"], financial, organization,
            tables["project"], ["row_id"], cf="A", **options,
        )
        return sorted(r.place for r in found["financial"].collect())

    assert statements() == list(range(1, 26))
    assert statements(shown=10) == list(range(1, 11))


def test_profile_types(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "True", "x", None, "1"), ("2", "2", "False", "1", None, None)],
        "a string, b string, c string, d string, e string, f string",
    )
    assert [r.dtype for r in catalogue.profile(df).orderBy("position").collect()] == [
        "int64", "float64", "bool", "object", "empty", "float64",
    ]
