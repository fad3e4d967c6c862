"""Amounts written in several locales, and checked casts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import trim_or_empty

# fixed values: what an accepted number looks like
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
COMMA_NUMBER = r"^[+-]?(\d+[.,]?\d*|[.,]\d+)([eE][+-]?\d+)?$"
WHOLE_NUMBER = r"^[+-]?\d+$"


def parse_amount(text: Column) -> Column:
    """Double from ``1.234,56``, ``1,234.56``, ``1234,5`` or ``1234.5``.

    With both separators the right-most one is the decimal mark; a lone comma
    is a decimal mark too.  Blank and unreadable text counts as zero.
    """
    value = F.replace(trim_or_empty(text), F.lit(" "), F.lit(""))
    point_is_decimal = F.contains(value, F.lit(".")) & value.rlike(r"\.[^.,]*$")
    plain = (
        F.when(~F.contains(value, F.lit(",")), value)
        .when(point_is_decimal, F.replace(value, F.lit(","), F.lit("")))
        .otherwise(F.translate(value, ",.", "."))
    )
    return F.when(plain.rlike(PLAIN_NUMBER), plain.try_cast("double")).otherwise(F.lit(0.0))


def decimal_comma(text: Column) -> Column:
    """Text with every decimal point turned into a comma."""
    return F.replace(text, F.lit("."), F.lit(","))


def double_with_comma(number: Column) -> Column:
    """Double as plain text with a decimal comma (``12,0``, ``0,25``), every digit kept.

    The text that reads back as the same double, its exponent written out.
    """
    # as a lambda, so that tables of many such columns still compile
    return F.transform(F.array(number.cast("string")), _expanded)[0]


def _expanded(text: Column) -> Column:
    sign = F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.substring_index(text, "E", 1), "[-.]", "")
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    whole = F.when(exponent >= 0, F.left(F.rpad(digits, exponent + 1, F.lit("0")), exponent + 1)).otherwise(F.lit("0"))
    rest = F.when(exponent >= 0, F.substring(digits, exponent + 2, F.length(digits))).otherwise(
        F.concat(F.repeat(F.lit("0"), -exponent - 1), digits)
    )
    written = F.concat(sign, whole, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
    plain = F.when(F.contains(text, F.lit("E")), written).otherwise(text)
    return decimal_comma(F.regexp_replace(plain, r"(\.\d+?)0+$", "$1"))


def checked_int(text: Column) -> Column:
    """Whole number from stripped text, null where it is none."""
    return F.when(text.rlike(WHOLE_NUMBER), text.try_cast("bigint"))


def checked_float(text: Column) -> Column:
    """Double from stripped text with a decimal comma or point, null where it is none."""
    return F.when(text.rlike(COMMA_NUMBER), F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))
