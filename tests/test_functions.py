import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.definition import DefinitionError, FieldMapping
from treeloom.functions.mapping import date_pattern, field_value
from treeloom.functions.text import csv_line, export_text, iso_date, json_value, package_file_name, text_of


def mapped(spark, cases):
    """Each (text, mapping) as parsed JSON and as flat text, in one job."""
    columns, row = [], {}
    for n, (text, mapping) in enumerate(cases):
        value = field_value(F.lit(text).cast("string"), T.StringType(), mapping)
        columns += [value.json().alias(f"j{n}"), value.text.alias(f"t{n}")]
    row = spark.range(1).select(*columns).first()
    return [(json.loads(row[f"j{n}"], parse_float=str), row[f"t{n}"]) for n in range(len(cases))]


def test_transforms_and_defaults(spark):
    m = FieldMapping
    cases = [
        ("hello", m(transform="uppercase")), ("HELLO", m(transform="lowercase")), ("  \t hi \n", m(transform="trim")),
        ("   ", m(default_value="d", transform="trim")), ("2026-08-19", m(transform="dateFormat", transform_arg="MM/dd/yyyy")),
        ("2026-08-19 13:05:00", m(transform="dateFormat", transform_arg="dd MMM yyyy 'at' h:mm tt")),
        ("8/19/2026", m(transform="dateFormat", transform_arg="yyyy-MM-ddTHH:mm")), ("soon", m(transform="dateFormat", transform_arg="yyyy")),
        ("2026-08-19", m(transform="dateFormat", transform_arg=" ")), (None, m(transform="constant", transform_arg="EU")),
        (None, m(default_value="unknown@example.com", transform="uppercase")), ("", m(default_value="d")), (None, m()), ("", m()),
    ]
    want = ["HELLO", "hello", "hi", "", "08/19/2026", "19 Aug 2026 at 1:05 PM", "2026-08-19T00:00", "soon", "2026-08-19",
            "EU", "unknown@example.com", "d", None, None]
    assert [j for j, _ in mapped(spark, cases)] == want
    assert [t for _, t in mapped(spark, cases)] == want


def test_numbers(spark):
    number = FieldMapping(data_type="number")
    good = {"42": 42, " 7.50 ": "7.50", "1,234": 1234, "5-": -5, "+3": 3, ".5": "0.5", "5.": 5, "007": 7, "1,2,3.4": "123.4", "-0": 0,
            "5 -": -5, "000.10": "0.10"}
    bad = ["not-a-number", "1e3", "--1", "-1-", ",1", "1.2.3", "1.2,3", "12 34", "- 5", "9" * 29, "."]
    got = mapped(spark, [(t, number) for t in [*good, *bad]])
    assert [j for j, _ in got] == [*good.values(), *bad]
    assert got[1][1] == "7.50" and got[-1][1] == "."


def test_booleans(spark):
    boolean = FieldMapping(data_type="boolean")
    got = mapped(spark, [(t, boolean) for t in ("true", " FALSE ", "t", "1", "yes")])
    assert [j for j, _ in got] == [True, False, "t", "1", "yes"]
    assert [t for _, t in got][:2] == ["true", "false"]


def test_constant_and_default_are_coerced(spark):
    got = mapped(spark, [(None, FieldMapping(None, "constant", "7", "number")), (None, FieldMapping("true", "none", None, "boolean"))])
    assert [j for j, _ in got] == [7, True]


def test_date_patterns():
    assert date_pattern("dddd, dd/MM/yyyy HH:mm:ss.fff tt zzz") == "EEEE, dd/MM/yyyy HH:mm:ss.SSS a xxx"
    assert date_pattern("yyyy'T'MM") == "yyyy'T'MM"
    for wrong in ("yyyy g", "t", "'open"):
        with pytest.raises(DefinitionError):
            date_pattern(wrong)


def test_number_text_follows_the_source_database(spark):
    values = [900.0, 12345678.9, 1.5, 0.0, -2.25, 1e15, 1.5e-7, 0.0001, 123456789012345.0, 1e100, None]
    want = ["900", "12345678.9", "1.5", "0", "-2.25", "1e+15", "1.5e-07", "0.0001", "123456789012345", "1e+100", None]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in frame.select(text_of(F.col("v"), T.DoubleType())).collect()] == want


def test_json_text_parses_back(spark):
    texts = ["plain", 'q"uote', "back\\slash", "line\nbreak\ttab\x01", "ünï©ode/", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [json.loads(r[0]) for r in frame.select(json_value(F.col("v"))).collect()] == texts


def test_csv_cells(spark):
    row = spark.createDataFrame([("a,b", 'say "x"', "two\nlines", None, " plain ")], "a string, b string, c string, d string, e string")
    assert row.select(csv_line([F.col(c) for c in "abcde"])).first()[0] == '"a,b","say ""x""","two\nlines",, plain '


def test_dates_and_names(spark):
    row = spark.sql("select timestamp'2026-06-28 06:00:00' t, date'2026-01-02' d")
    got = row.select(
        export_text(F.col("t"), T.TimestampType()), export_text(F.col("d"), T.DateType()), text_of(F.col("t"), T.TimestampType()),
        package_file_name(F.lit(42), F.col("t"), "xlsx"), package_file_name(F.lit(123456), F.col("t"), "csv"),
        iso_date(F.lit("2026-02-30")), iso_date(F.lit("2026-02-03x")), iso_date(F.lit("2026-02-03")).cast("string"),
    ).first()
    assert tuple(got) == (
        "2026-06-28", "2026-01-02", "2026-06-28 06:00:00", "export_0042_20260628T060000Z.xlsx",
        "export_123456_20260628T060000Z.csv", None, None, "2026-02-03",
    )
