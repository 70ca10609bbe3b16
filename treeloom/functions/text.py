"""Text forms of column values: plain text, JSON text, CSV cells."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types whose text holds nothing that JSON escapes.
PLAIN_TYPES = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def text_of(column: Column, data_type: T.DataType) -> Column:
    """The value as text. Fractions are written as the source database writes them: shortest digits,
    no trailing ``.0``, an exponent only below 1e-4 and from 1e15 up."""
    if not isinstance(data_type, (T.DoubleType, T.FloatType)):
        return column.cast("string")
    shortest = column.cast("string")
    size = F.abs(column)
    plain = F.regexp_replace(shortest, r"\.0$", "")
    # Digits beyond Spark's own plain range, through a decimal so that no digit is invented.
    spelled = F.regexp_replace(shortest.cast("decimal(38,22)").cast("string"), r"\.?0+$", "")
    parts = F.split(shortest, "E")
    power = parts.getItem(1).cast("int")
    exponent = F.concat(
        F.regexp_replace(parts.getItem(0), r"\.0$", ""),
        F.when(power < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(power).cast("string"), 2, "0"),
    )
    exponent = F.when(F.abs(power) > 99, F.regexp_replace(exponent, r"e([+-]).*$", "e$1")).otherwise(exponent)
    exponent = F.when(F.abs(power) > 99, F.concat(exponent, F.abs(power).cast("string"))).otherwise(exponent)
    return (
        F.when(F.isnan(column) | (size == float("inf")) | (size == 0), plain)
        .when((size >= 1e-3) & (size < 1e7), plain)
        .when((size >= 1e-4) & (size < 1e15), spelled)
        .otherwise(exponent)
    )


def export_text(column: Column, data_type: T.DataType) -> Column:
    """Flat-export text: dates and timestamps as ``yyyy-MM-dd``."""
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd")
    return text_of(column, data_type)


def json_value(text: Column, data_type: T.DataType | None = None) -> Column:
    """Text as a JSON string; NULL becomes ``null``. Only text that needs escapes goes through the
    JSON writer, and text of numbers, dates and booleans never does."""
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    if data_type is None or not isinstance(data_type, PLAIN_TYPES):
        document = F.to_json(F.struct(text.alias("v")))
        escaped = F.substring(document, F.lit(6), F.length(document) - 6)
        quoted = F.when(text.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(quoted)
    return F.coalesce(quoted, F.lit("null"))


def json_key(key: str) -> str:
    return json.dumps(key, ensure_ascii=False) + ":"


def csv_cell(column: Column) -> Column:
    """One CSV cell: quoted when it holds a comma, a quote or a line break; NULL is empty."""
    text = F.coalesce(column, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def csv_line(columns: list[Column]) -> Column:
    return F.concat_ws(",", *[csv_cell(column) for column in columns])


def sha256_short(column: Column) -> Column:
    return F.substring(column, 1, 12)


def package_file_name(sequence: Column, extracted_at: Column, extension: str) -> Column:
    """``export_0042_20260628T060000Z.json``; the session time zone must be UTC."""
    stamp = F.date_format(extracted_at, "yyyyMMdd'T'HHmmss'Z'")
    digits = F.abs(sequence).cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat(F.lit("export_"), padded, F.lit("_"), stamp, F.lit("." + extension))


def iso_date(column: Column) -> Column:
    """The date written as exactly ``yyyy-MM-dd``, else NULL."""
    return F.when(column.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(column, "yyyy-MM-dd"))
