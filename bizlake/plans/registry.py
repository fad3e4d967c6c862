"""Company registry: clean both sheets, key sites and companies, write eight exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from .. import config
from ..functions import (
    age_years, date_or_null, repair_shifted_year, scrub, site_key, site_number, strict_date,
)
from ..operators.dedup import drop_repeated_when, keep_first, repeated_keys
from ..operators.joins import join_by, keep_matching
from ..operators.order import number_rows
from ..session import settle


def date_columns(df: DataFrame) -> list[str]:
    """Columns whose name starts with ``data``."""
    return [c for c in df.columns if c.startswith("data")]


def with_source(df: DataFrame, snapshot: str) -> DataFrame:
    """Add where the rows come from and which month they show."""
    return df.withColumns({"fonte": F.lit("I"), "mm_aaaa": F.lit(snapshot)})


def clean_sites(df: DataFrame, snapshot: str, strict: bool = False) -> DataFrame:
    """Add source, site number and key; scrub text; repair dates.

    ``strict`` stops the job on a date that cannot exist; otherwise it is null.
    """
    to_date = strict_date if strict else date_or_null
    return (
        with_source(df, snapshot)
        .withColumn("n_sede", site_number(F.col("sede_ul")))
        .withColumns({c: scrub(F.col(c)) for c in config.REGISTRY_TEXT_COLUMNS if c in df.columns})
        .withColumns({c: to_date(repair_shifted_year(F.col(c))) for c in date_columns(df)})
        .withColumn("key_cfl", site_key(F.col("cf"), F.col("n_sede")))
    )


def with_age(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Add the earliest date of each row and the years since then."""
    dates = [F.col(c) for c in date_columns(df)]
    earliest = F.least(*dates) if len(dates) > 1 else dates[0]
    return df.withColumn("min_date", earliest).withColumn(
        "anni", age_years(F.lit(as_of), F.col("min_date"))
    )


def is_headquarters() -> Column:
    return F.col("sede_ul") == config.HEADQUARTERS


def site_flag() -> Column:
    """``s`` for headquarters, ``u`` for any other unit."""
    return F.when(is_headquarters(), F.lit("s")).otherwise(F.lit("u"))


def company_ids(sites: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One row per company: cf, id_impresa (1..n by first row), has_hq."""
    companies = sites.groupBy("cf").agg(
        F.min(row_id).alias("_first"), F.max(is_headquarters()).alias("has_hq")
    )
    return number_rows(companies, ["_first"], "id_impresa").drop("_first")


def key_sites(sites: DataFrame, companies: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Add id_localiz, id_impresa and the site flag; drop companies without headquarters.

    One join carries the company id and the headquarters test together.
    """
    return (
        join_by(sites, companies.filter("has_hq").drop("has_hq"), ["cf"])
        .withColumn("id_localiz", F.col(row_id).cast("bigint"))
        .withColumn("SEDE_UL_num", site_flag())
    )


def drop_foreign_duplicates(sites: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Of repeated (cf, sede_ul) rows, drop those registered by another province.

    A group goes away entirely when every member is registered elsewhere.
    ``repeated`` holds the repeated keys, where they are known.
    """
    elsewhere = F.col("prov") != F.col("prov_camera_commercio")
    return drop_repeated_when(sites, ["cf", "sede_ul"], elsewhere, repeated=repeated)


def build_sites(
    raw: DataFrame, snapshot: str, as_of: dt.date, row_id: str = "row_id", strict: bool = False
) -> DataFrame:
    """The cleaned, keyed registry sheet.

    Company ids and repeated sites are worked out on the key columns of the raw
    sheet; dropping whole companies does not change which sites repeat.  Cleaning
    changes none of the columns that rows are dropped by, so that raw rows are
    joined and only those that stay are cleaned; ``strict`` looks at all of them.
    """
    def cleaned(df: DataFrame) -> DataFrame:
        return with_age(clean_sites(df, snapshot, strict), as_of)

    companies = company_ids(raw, row_id)
    repeated = settle(repeated_keys(raw.select("cf", "sede_ul"), ["cf", "sede_ul"]), "repeated")
    if strict:
        return drop_foreign_duplicates(key_sites(cleaned(raw), companies, row_id), repeated)
    keyed = key_sites(raw, companies, row_id)
    added = ["id_impresa", "id_localiz", "SEDE_UL_num"]
    kept = cleaned(drop_foreign_duplicates(keyed, repeated))
    return kept.select(*[c for c in kept.columns if c not in added], *added)


def build_activities(raw: DataFrame, sites: DataFrame, snapshot: str) -> DataFrame:
    """The activity-code sheet with the ids of its site.

    Codes of unknown sites fall away; so do those of companies without
    headquarters, which ``sites`` no longer holds.  A site key that is still
    repeated in the registry repeats its codes.
    """
    ids = sites.select("key_cfl", "id_impresa", "id_localiz")
    keyed = with_source(raw, snapshot).withColumn(
        "key_cfl", site_key(F.col("cf"), F.col("loc_n"))
    )
    return join_by(keyed, ids, ["key_cfl"])


def best_headquarters(sites: DataFrame) -> DataFrame:
    """One headquarters row per company.

    Latest registry date first, then not cancelled, then name descending,
    province and REA number ascending.
    """
    hq = sites.filter(is_headquarters())
    dates = [F.col(c) for c in config.HEADQUARTERS_DATE_COLUMNS if c in sites.columns]
    latest = F.greatest(*dates) if len(dates) > 1 else dates[0]
    cancelled = F.col("data_canc").isNotNull().cast("int")
    ranked = hq.withColumns({"_latest": latest, "_cancelled": cancelled})
    order = [
        F.desc_nulls_last("_latest"), F.asc("_cancelled"), F.desc_nulls_last("denominazione"),
        F.asc_nulls_last("prov"), F.asc_nulls_last("rea"), F.asc("id_localiz"),
    ]
    return keep_first(ranked, ["cf"], order).drop("_latest", "_cancelled")


def in_scope(site: Column, province: Column, headquarters: str) -> Column:
    """Headquarters anywhere, other units only in the home provinces."""
    return (site == headquarters) | province.isin(config.HOME_PROVINCES)


def with_site_class(sites: DataFrame) -> DataFrame:
    """Join the five site-class columns into one."""
    return sites.withColumn(
        "tipo_sedeul", F.concat(*config.SITE_CLASS_COLUMNS)
    ).drop(*config.SITE_CLASS_COLUMNS)


def site_exports(sites: DataFrame) -> dict[str, DataFrame]:
    """The four exports of the registry sheet, before their column layouts."""
    return {
        "repository_registry": with_site_class(sites),
        "headquarters": best_headquarters(sites),
        "registry": sites,
        "registry_filtered": sites.filter(
            in_scope(F.col("sede_ul"), F.col("prov"), config.HEADQUARTERS)
        ),
    }


def activity_exports(activities: DataFrame) -> dict[str, DataFrame]:
    """The four exports of the activity sheet, before their column layouts."""
    return {
        "repository_activities": activities,
        "headquarters_activities": activities.filter(F.col("loc_n") == "0"),
        "activities": activities,
        "activities_filtered": activities.filter(in_scope(F.col("loc_n"), F.col("prov"), "0")),
    }


def run_registry(
    raw_sites: DataFrame, raw_activities: DataFrame, snapshot: str, as_of: dt.date,
    strict: bool = False,
) -> dict[str, DataFrame]:
    """Both sheets in, eight exports out; each cleaned sheet is written once."""
    sites = settle(build_sites(raw_sites, snapshot, as_of, strict=strict), "sites")
    activities = settle(build_activities(raw_activities, sites, snapshot), "activities")
    return site_exports(sites) | activity_exports(activities)


def companies_without_headquarters(sites: DataFrame) -> DataFrame:
    """Companies that only have other units."""
    counted = sites.groupBy("cf").agg(F.sum(is_headquarters().cast("bigint")).alias("n_hq"))
    return counted.filter("n_hq = 0").select("cf")


def only_with_headquarters(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows of companies that have headquarters in ``sites``."""
    return keep_matching(df, sites.filter(is_headquarters()), "cf")
