"""Company and site identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import trim_or_empty


def site_number(site: Column) -> Column:
    """Number after the three-letter site prefix; headquarters count as ``0``."""
    tail = F.substr(site, F.lit(4))
    return F.when(tail == "E", F.lit("0")).otherwise(tail)


def site_key(tax_code: Column, number: Column) -> Column:
    """Key of one site of one company."""
    return F.concat(tax_code, F.lit("_"), number)


def strip_country_prefix(vat: Column) -> Column:
    """VAT number without its two leading characters."""
    return F.substr(vat, F.lit(3))


def normalise_identifier(identifier: Column) -> Column:
    """Identifier without byte-order marks and outer white space, never null."""
    return trim_or_empty(F.replace(identifier, F.lit("\ufeff"), F.lit("")))
