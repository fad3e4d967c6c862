"""From files to serving tables on a small invented dataset."""

import datetime as dt

from bizlake import config
from bizlake.plans import jobs, loading, serving
from bizlake.sources.delimited import read_delimited
from bizlake.suite.samples import workbook_bytes

TODAY = dt.date(2024, 6, 30)

SITE = ["codice", "piva", "sede_ul", "prov", "prov_camera_commercio", "rea", "denominazione",
        "descrizione_attivita", "indirizzo", "stato_impresa", "tipo_impresa", "comune",
        *config.SITE_CLASS_COLUMNS, "data_isc_ri", "data_cost", "data_canc"]


def site(cf, piva, unit, prov, name):
    return [cf, piva, unit, prov, prov, "7", name, "", "", "ATTIVA", "SRL", "Udine",
            "a", "", "", "", "", "5010-01-01", "", ""]


def statements(path, year, *companies):
    header = ";".join(f'"{name}"' for name, _, _ in config.FINANCIAL_SCHEMA)
    body = [";".join([cf, "UD", "007", year, *[amount] * 17]) for cf, amount in companies]
    path.write_text("\n".join([header, *body]) + "\n", encoding="utf-8")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_from_files_to_serving_tables(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    sheets = {
        config.WORKBOOK_SHEETS[0]: [
            SITE, site("001", "01234567890", "SEDE", "UD", 'Alfa "1"'),
            site("001", "01234567890", "UL-1", "MI", "Alfa"),
            site("002", "11111111111", "SEDE", "NA", "Beta"), site("003", "3", "UL-1", "UD", "Gone"),
        ],
        config.WORKBOOK_SHEETS[1]: [config.ACTIVITY_COLUMNS, ["001", "7", "UD", "0", "P", "62", "x"]],
    }
    (source / "imprese_home_05_2024.xlsx").write_bytes(workbook_bytes(sheets))
    (source / "imprese_home_09_2024.xlsx").write_bytes(b"from the future")
    jobs.registry_job(spark, str(source), str(out), TODAY,
                      renames={config.WORKBOOK_SHEETS[0]: {"codice": "cf"}})
    filtered = read_delimited(spark, f"{out}/registry_filtered.csv", "|", blanks="keep")
    assert rows(filtered, "cf", "sede_ul", "prov", "denominazione", "id_impresa", "mm_aaaa") == [
        ("001", "SEDE", "UD", "Alfa  1", "1", "05_2024"), ("002", "SEDE", "NA", "Beta", "2", "05_2024"),
    ]

    for name, programme in (("one", "H2020"), ("two", "HORIZON")):
        folder = source / name
        folder.mkdir()
        (folder / "organization.csv").write_text(
            "projectID;vatNumber;name;country;role;ecContribution;netEcContribution;contentUpdateDate\n"
            f"{name};IT01234567890;Alfa;IT;coordinator;10.5;10.5;2024-01-01 10:00:00\n"
            f"{name};DE1;Gamma;DE;participant;1;1;2024-01-01 10:00:00\n"
            "other;DE1;Gamma;DE;participant;1;1;2024-01-01 10:00:00\n")
        (folder / "project.csv").write_text(
            "id;acronym;startDate;frameworkProgramme\n"
            f'{name};"A;B";2020-01-01;{programme}\n{name}x;bad;2020;{programme};too;long\n')
        (folder / "euroSciVoc.csv").write_text(f"projectID;euroSciVocPath\n{name};/a/\n")
    jobs.participation_job(
        spark, f"{source}/one", f"{source}/two", f"{out}/registry_filtered.csv", str(out))
    projects = read_delimited(spark, f"{out}/project.csv", "|", blanks="keep")
    assert rows(projects, "projectID", "acronym", "frameworkProgramme", "coordinator", "participants") == [
        ("one", "A;B", "H2020", "Alfa", "Gamma"), ("two", "A;B", "HORIZON EUROPE", "Alfa", "Gamma"),
    ]
    topics = read_delimited(spark, f"{out}/topics.csv", "|", blanks="keep")
    assert rows(topics, "projectID", "livello_2") == [("one", ""), ("two", "a")]

    (source / "older").mkdir()
    statements(source / "older" / "bilanci_2022.csv", "2022", ("001", "1000,5"), ("999", "2"), ("002", "abc"))
    jobs.financial_job(spark, str(source), str(out), 2022)
    statements(source / "bilanci_2023.csv", "2023", ("001", "3"))
    jobs.financial_job(spark, str(source), str(out), 2024)
    valid = read_delimited(spark, f"{out}/financial.csv", "|", blanks="keep")
    assert rows(valid, "c fiscale", "anno", "Ricavi delle vendite", "`tot.aam.acc.svalutazioni`") == [
        ("001", "2023", "3,0", "3,0"), ("999", "2022", "2,0", "2,0"),
    ]

    load = jobs.serving_job(spark, {
        "headquarters": f"{out}/headquarters.csv", "registry": f"{out}/registry_filtered.csv",
        "financial": f"{out}/financial.csv", "project": f"{out}/project.csv",
        "organization": f"{out}/organization.csv", "topics": f"{out}/topics.csv",
    }, str(tmp_path / "served"))
    tables = loading.published_tables(spark, str(tmp_path / "served"), serving.TABLES)
    assert rows(load.report("financial", "organization", "topics"), "table_name", "loaded", "skipped") == [
        ("financial", 1, 1), ("organization", 2, 0), ("topics", 2, 0),
    ]
    assert rows(tables["organization"], "projectID", "cf", "ecContribution") == [
        ("one", "001", "10,5"), ("two", "001", "10,5"),
    ]
    assert rows(tables["headquarters"], "cf", "prov") == [("001", "UD"), ("002", "NA")]
