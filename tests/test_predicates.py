"""Scalar predicates on literal probes, with the lenient Python parsers as the yardstick."""

import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulens.functions import fields, predicates

NUMBERS = ["1", "-1.5", "+.5", "5.", "1e5", "1E-3", "1,234.50", "1_000", "inf", "-Infinity", "nan", " 7 ", "1,50"]
NOT_NUMBERS = ["", "1d", "1.0f", "abc", "1__0", "_1", "1e", "--1", "0x10", "1 2", "12.3.4", "张三"]
DATES = [
    "2025-01-01", "2025-1-5", "2025/01/31", "2025.01.05", "2025-01-01 10:00:00", "2025-01-01T10:00", "01/31/2025",
    "31/01/2025", "2025-01-01T10:00:00Z", "2025-01-01 10:00:00.123", "12:30", "12:30:59", "10:30 AM", "20250131",
    "2025", "2025Q1", "2025-01", "01/2025", "Jan 5 2025", "January 5, 2025", "05-Jan-2025", "Jan 2025", "1,50",
]
NOT_DATES = [
    "1", "12345", "99.99", "A", "May", "Q1", "1/2", "2025-02-30", "2025-13-01", "not a date", "20251301", "12345678",
    "0,75", "3,14", "1,900", "2-HIGH", "9999-12-31", "1600", "C12",
]


def judge(spark, values, expression):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r.v: r.x for r in df.select("v", expression(F.col("v")).alias("x")).collect()}


def parses_as_float(text):
    try:
        float(text.replace(",", ""))
        return True
    except ValueError:
        return False


def parses_as_date(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            pd.to_datetime(text)
            return True
        except Exception:
            return False


def test_numeric(spark):
    found = judge(spark, NUMBERS + NOT_NUMBERS, predicates.is_numeric)
    assert found == {v: v in NUMBERS for v in NUMBERS + NOT_NUMBERS}
    assert found == {v: parses_as_float(v) for v in found}


def test_datetime(spark):
    found = judge(spark, DATES + NOT_DATES, predicates.is_datetime)
    assert found == {v: v in DATES for v in DATES + NOT_DATES}
    assert found == {v: parses_as_date(v) for v in found}


def test_to_number(spark):
    found = judge(spark, ["1,50", "1,234.50", "1_000", "nan", "1d", " 7 ", "", "-inf"], predicates.to_number)
    assert found == {
        "1,50": 150.0, "1,234.50": 1234.5, "1_000": None, "nan": None, "1d": None, " 7 ": 7.0, "": None,
        "-inf": float("-inf"),
    }


def test_null_tokens(spark):
    found = judge(spark, ["NA", "na", " NA", "", "null", "0"], predicates.null_tokens_to_null)
    assert found == {"NA": None, "na": "na", " NA": " NA", "": None, "null": None, "0": "0"}


def test_header_likeness(spark):
    sentence = "This is a very long text that looks more like data than a header name"
    found = judge(
        spark, ["user_id", "timestamp", "ProductName", "12345", "2025-01-01", "99.99", sentence, ""],
        predicates.header_likeness,
    )
    assert min(found["user_id"], found["timestamp"], found["ProductName"]) > 0.7
    assert max(found["12345"], found["2025-01-01"], found["99.99"]) < 0.5
    assert found[sentence] < 0.6 and found[""] == 0


def test_comment_lines(spark):
    found = judge(spark, ["# a", "  // b", "-- c", "/* d", "<!-- e", ";f", "%g", "h # i", "", "-j"], predicates.is_comment_line)
    assert [v for v, x in found.items() if x] == ["# a", "  // b", "-- c", "/* d", "<!-- e", ";f", "%g"]


@pytest.mark.parametrize("delimiter", fields.DELIMITERS)
def test_quoted_split(spark, delimiter):
    import csv

    lines = [
        "a,b,c", 'a,"b,c",d', '"x ""y"" z",1', '"",2,""', ",,", "", '5" pipe,2', '"a,b', "one", '""""',
        '"' + '""k"",' * 20000 + '",end',
    ]
    lines = [line.replace(",", delimiter) for line in lines]
    split = judge(spark, lines, lambda v: fields.quoted_split(v, delimiter))
    count = judge(spark, lines, lambda v: fields.field_count(v, delimiter))
    for line in lines:
        if line.startswith('"a') or not line:  # an open quote would swallow the following lines
            continue
        expected = next(csv.reader([line], delimiter=delimiter))
        assert split[line] == expected
        assert count[line] == len(expected)
