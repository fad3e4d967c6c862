"""Column functions on hand-written values, one block per trap."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bizlake import functions as fn


def test_year_shift_repair(apply):
    values = ["x", "1799-03-01", "2100-03-01", "4987-03-01", "5021-03-01", "1987-03-01",
              "5121-01-01", "4787-01-01", "5221-01-01", "", None, "4987-03-01 00:00:00"]
    assert apply(values, fn.repair_shifted_year) == [
        None, None, None, "1987-03-01", "2021-03-01", None, "2121-01-01", None, None, None, None,
        "1987-03-01",
    ]


def test_strict_date_stops_on_a_day_that_does_not_exist(apply):
    assert apply(["1987-03-01", None], fn.strict_date) == [dt.date(1987, 3, 1), None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        apply(["1987-13-01"], fn.strict_date)


def test_dates_or_null(apply):
    values = ["2022-08-15", "2022-08-15 16:25:02", "2022-08-15T16:25:02", "soon", "", None,
              "2022-02-30"]
    day = dt.date(2022, 8, 15)
    assert apply(values, fn.date_or_null) == [day, day, day, None, None, None, None]


def test_day_first_dates(apply):
    values = ["15/08/2022", "01-02-2022", "03/04/2022 10:00:00", "2022-08-15 16:25:02", "31/02/2022"]
    assert apply(values, fn.day_first_date) == [
        dt.date(2022, 8, 15), dt.date(2022, 2, 1), dt.date(2022, 4, 3), dt.date(2022, 8, 15), None,
    ]


def test_age_counts_years_of_365_days(apply):
    ages = apply([dt.date(2020, 1, 1), None], lambda c: fn.age_years(F.lit(dt.date(2021, 1, 1)), c), "date")
    assert ages == [366 / 365, None]


def test_locale_amounts(apply):
    values = {
        "": 0.0, None: 0.0, "1.234,56": 1234.56, "1,234.56": 1234.56, "1234,5": 1234.5,
        "1.234": 1.234, "1 234,5": 1234.5, "1.234.567": 0.0, "1,234,567": 0.0, "abc": 0.0,
        "-12,5": -12.5, "1e3": 1000.0, "nan": 0.0, "1_0": 0.0, "1d": 0.0, " 7,5 ": 7.5,
        "1.234.567,89": 1234567.89, "1,234,567.89": 1234567.89, "+3": 3.0, ".5": 0.5, ",5": 0.5,
    }
    assert apply(list(values), fn.parse_amount) == list(values.values())


def test_scrub_keeps_inner_runs(apply):
    values = ['a\n"b"  |#c', "_x000D_x-*y\t", "A  B", None]
    assert apply(values, fn.scrub) == ["a  b     c", "x  y", "A  B", None]


def test_strip_removes_every_white_space(apply):
    assert apply(["  a b\t ", "\n", None], fn.strip) == ["a b", "", None]
    assert apply(["  a b\t ", None], fn.trim_or_empty) == ["a b", ""]


def test_identifiers(apply):
    assert apply(["SEDE", "UL-3", "UL-12"], fn.site_number) == ["0", "3", "12"]
    assert apply(["IT01234567890", "DE1"], fn.strip_country_prefix) == ["01234567890", "1"]
    assert apply(["\ufeff 0012 ", None], fn.normalise_identifier) == ["0012", ""]


def test_topic_levels(apply):
    paths = ["/a/b/c", "/a", "/a/", None]
    assert apply(paths, fn.topic_level_1) == ["a", "a", "a", None]
    assert apply(paths, lambda c: fn.topic_level_2(c, False)) == ["b", "a", "", None]
    assert apply(paths, lambda c: fn.topic_level_2(c, True)) == ["b", "a", "a", None]


def test_programme_label_is_not_idempotent(apply):
    once = apply(["HORIZON", "H2020", None], fn.programme_label)
    assert once == ["HORIZON EUROPE", "H2020", None]
    assert apply(once[:1], fn.programme_label) == ["HORIZON EUROPE EUROPE"]


def test_missing_value_words(apply):
    assert apply(["NA", "None", "null", "", "Naples", None], fn.null_when_token) == [
        None, None, None, None, "Naples", None,
    ]


def test_decimal_commas(apply):
    assert apply(["12.50", None], fn.decimal_comma) == ["12,50", None]
    numbers = [12.0, 0.25, 10000000.0, -3.1, None, 1234567.89]
    assert apply(numbers, fn.double_with_comma, "double") == [
        "12,0", "0,25", "10000000,0", "-3,1", None, "1234567,89",
    ]


def test_decimal_comma_keeps_every_digit(spark):
    from pyspark.sql import functions as F

    from bizlake.functions.amounts import double_with_comma

    numbers = [0.1234567890123, 1e-13, 1e15, -2.5e-7, 1234567.891, 1.7976931348623157e308, 0.0, -12.0]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    texts = [r.t for r in df.select(double_with_comma(F.col("x")).alias("t")).collect()]
    assert [float(t.replace(",", ".")) for t in texts] == numbers
    assert not any("E" in t for t in texts)
    assert texts[1] == "0," + "0" * 12 + "1" and texts[-1] == "-12,0"


def test_delimiters_of_long_quoted_records(spark):
    from pyspark.sql import functions as F

    from bizlake.sources.delimited import count_delimiters

    record = 'a;"' + 'x;""' * 250_000 + '";b'
    df = spark.createDataFrame([(record,)], "r string")
    assert df.select(count_delimiters(F.col("r"), ";").alias("n")).first().n == 2


def test_strip_at_either_end(apply):
    white = ["\u3000a", "a\u3000", "\x85a\x1c", " ", "", None, "\x7f", "é", " é ", "a b", "a\x7f ", "!", "~", "\u200ba "]
    assert apply(white, fn.strip) == ["a", "a", "a", "", "", None, "\x7f", "é", "é", "a b", "a\x7f", "!", "~", "\u200ba"]
