"""Dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed value: day, month and year written in that order, and what follows
DAY_FIRST = r"^(\d{2})[/-](\d{2})[/-](\d{4})"


def repair_shifted_year(text: Column) -> Column:
    """Undo the 3000-year shift of registry dates.

    The first two digits tell the century: 48 to 51 become 18 to 21, and text
    with any other start (or fewer than four characters) becomes null.
    """
    day = F.substr(text, F.lit(1), F.lit(10))
    century = F.substr(day, F.lit(1), F.lit(2))
    earlier = F.when(century == "48", "18").when(century == "49", "19").when(century == "50", "20").when(century == "51", "21")
    return F.when(F.length(day) >= 4, F.concat(earlier, F.substr(day, F.lit(3))))


def strict_date(text: Column) -> Column:
    """Date from ``yyyy-MM-dd``; a bad value stops the job (in ANSI mode, the default)."""
    return text.cast("date")


def date_or_null(text: Column) -> Column:
    """Date from an ISO date or timestamp, null where the text is neither."""
    return text.try_cast("timestamp_ntz").cast("date")


def day_first_date(text: Column) -> Column:
    """Date from ISO or day-first text, time of day dropped, null where neither fits."""
    return date_or_null(F.regexp_replace(text, DAY_FIRST, "$3-$2-$1"))


def age_years(as_of: Column, since: Column) -> Column:
    """Years of 365 days between two dates."""
    return F.date_diff(as_of, since) / F.lit(365.0)


def year_text(iso_date: Column) -> Column:
    """Year of an ISO date, as text."""
    return F.substr(F.coalesce(iso_date, F.lit("")), F.lit(1), F.lit(4))
