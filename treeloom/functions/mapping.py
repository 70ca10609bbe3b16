"""Field mappings as column expressions. No mapping fails a job on a bad value: what cannot be
converted stays text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.definition import NATIVE, DefinitionError, FieldMapping
from treeloom.functions.text import json_value, text_of

# What the source system trims, and what it accepts as a number: digits with optional
# group commas, one point, one sign before or behind, white space around, no exponent.
WHITE = r"[\s\p{Z}\x85]+"
NUMBER = (
    r"^[\t-\r ]*(?:[+-]?(?:\d[\d,]*(?:\.\d*)?|\.\d+)"
    r"|(?:\d[\d,]*(?:\.\d*)?|\.\d+)[\t-\r ]*[+-])[\t-\r ]*$"
)
BOOLEAN = r"^[\s\p{Z}\x00]*(?i:true|false)[\s\p{Z}\x00]*$"
# The range of the source system's decimals, 96 bits with up to 28 digits behind the point.
MOST = "79228162514264337593543950335"
PLAIN_DIGITS, MOST_DIGITS, MOST_SCALE = 28, 29, 28

# Date tokens of definition documents and their Spark spellings.
DATE_TOKENS = {
    "d": "d", "dd": "dd", "ddd": "EEE", "dddd": "EEEE",
    "M": "M", "MM": "MM", "MMM": "MMM", "MMMM": "MMMM",
    "yy": "yy", "yyy": "yyy", "yyyy": "yyyy",
    "H": "H", "HH": "HH", "h": "h", "hh": "hh", "m": "m", "mm": "mm", "s": "s", "ss": "ss",
    "f": "S", "ff": "SS", "fff": "SSS", "ffff": "SSSS", "fffff": "SSSSS", "ffffff": "SSSSSS",
    "tt": "a", "zzz": "xxx",
}
REFUSED_LETTERS = "dMyHhmsfFgKtz"


@dataclass(frozen=True)
class Value:
    """A mapped field: its text or, where ``bare`` holds, text that is JSON without quotes."""

    plain: Column
    bare: Column | None = None
    unquoted: Column | None = None
    data_type: T.DataType | None = None

    @property
    def text(self) -> Column:
        return self.plain if self.bare is None else F.when(self.bare, self.unquoted).otherwise(self.plain)

    def json(self) -> Column:
        quoted = json_value(self.plain, self.data_type)
        return quoted if self.bare is None else F.when(self.bare, self.unquoted).otherwise(quoted)


def field_value(column: Column, data_type: T.DataType, mapping: FieldMapping | None) -> Value:
    if mapping is not None and mapping.data_type == NATIVE:
        return _native(column, data_type)
    text = text_of(column, data_type)
    return Value(text, data_type=data_type) if mapping is None else _coerce(mapped_text(text, mapping), mapping.data_type)


def mapped_text(text: Column, mapping: FieldMapping) -> Column:
    if mapping.transform == "constant":
        return F.lit(mapping.transform_arg or "")
    missing = text.isNull() | (text == "")
    return F.when(missing, F.lit(mapping.default_value).cast("string")).otherwise(_transform(text, mapping))


def _transform(text: Column, mapping: FieldMapping) -> Column:
    if mapping.transform == "uppercase":
        return F.upper(text)
    if mapping.transform == "lowercase":
        return F.lower(text)
    if mapping.transform == "trim":
        return trim_text(text)
    if mapping.transform == "dateFormat":
        return format_date(text, mapping.transform_arg)
    return text


def trim_text(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}|{WHITE}$", "")


def format_date(text: Column, pattern: str | None) -> Column:
    if pattern is None or not pattern.strip():
        return text
    iso = F.when(text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), F.trim(text)).try_cast("timestamp")
    slashed = F.try_to_timestamp(F.trim(text), F.lit("M/d/yyyy[ H:m[:s]]"))
    return F.coalesce(F.date_format(F.coalesce(iso, slashed), date_pattern(pattern)), text)


def date_pattern(pattern: str) -> str:
    """The definition's date pattern in Spark's letters. Letters that mean nothing stay themselves."""
    out, at = [], 0
    while at < len(pattern):
        letter = pattern[at]
        if letter in "'\"":
            end = pattern.find(letter, at + 1)
            if end < 0:
                raise DefinitionError(f"unclosed quote in date pattern {pattern!r}")
            out.append("'" + pattern[at + 1 : end].replace("'", "''") + "'")
            at = end + 1
            continue
        end = at
        while end < len(pattern) and pattern[end] == letter:
            end += 1
        run = pattern[at:end]
        if run in DATE_TOKENS:
            out.append(DATE_TOKENS[run])
        elif letter in REFUSED_LETTERS or letter in "\\%":
            raise DefinitionError(f"date pattern {pattern!r}: {run!r} is not supported")
        elif letter.isalpha() or letter in "[]{}#":
            out.append(f"'{run}'")
        else:
            out.append(run)
        at = end
    return "".join(out)


def is_number(text: Column) -> Column:
    """Whether a text is a number within the range of decimals; its fraction may be of any length."""
    fits = (F.length(text) <= PLAIN_DIGITS) | _with(_digits(text), _in_range)
    return F.coalesce(text.rlike(NUMBER) & fits, F.lit(False))


def number_text(text: Column) -> Column:
    """Accepted number text in plain form, scale kept: ``" 1,234.50- "`` becomes ``-1234.50``. Digits that a decimal
    cannot hold behind the point are rounded away, halves to the even neighbour."""
    plain = _digits(text)
    plain = F.when(F.length(text) <= PLAIN_DIGITS, plain).otherwise(_with(plain, _rounded))
    return F.when(text.contains("-") & plain.rlike("[1-9]"), F.concat(F.lit("-"), plain)).otherwise(plain)


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _in_range(plain: Column) -> Column:
    whole = F.regexp_replace(F.substring_index(plain, ".", 1), "^0+", "")
    top = _mantissa(plain, F.lit(0)) <= F.lit(MOST).cast("decimal(38,0)")
    return (F.length(whole) < MOST_DIGITS) | ((F.length(whole) == MOST_DIGITS) & top)


def _digits(text: Column) -> Column:
    """Digits and point, with one digit before the point and none of the zeros before that."""
    digits = F.regexp_replace(F.translate(text, "+-, \t\n\x0b\x0c\r", ""), r"^0+(?=\d)|\.$", "")
    return F.when(digits.startswith("."), F.concat(F.lit("0"), digits)).otherwise(digits)


def _fraction(plain: Column) -> Column:
    return F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise("")


def _mantissa(plain: Column, scale: Column) -> Column:
    """The digits down to ``scale`` behind the point as a whole number, rounded by those after them."""
    fraction = _fraction(plain)
    kept = F.concat(F.substring_index(plain, ".", 1), F.substring(fraction, F.lit(1), scale)).try_cast("decimal(38,0)")
    rest = F.substring(fraction, scale + 1, F.length(fraction))
    above = (F.substring(rest, 1, 1) > "5") | rest.rlike("^5.*[1-9]") | (rest.rlike("^5") & (kept % 2 == 1))
    return kept + F.when(above, F.lit(1)).otherwise(F.lit(0))


def _rounded(plain: Column) -> Column:
    whole = F.regexp_replace(F.substring_index(plain, ".", 1), "^0+", "")
    scale = F.least(F.length(_fraction(plain)), F.lit(MOST_SCALE), F.lit(MOST_DIGITS) - F.length(whole))

    def at(scale: Column) -> Column:
        fits = _mantissa(plain, scale) <= F.lit(MOST).cast("decimal(38,0)")
        used = F.when(fits, scale).otherwise(scale - 1)
        return _with(used, lambda s: _with(_mantissa(plain, s), lambda m: _pointed(m, s)))

    return _with(scale, at)


def _pointed(mantissa: Column, scale: Column) -> Column:
    text = mantissa.cast("decimal(38,0)").cast("string")
    text = F.when(F.length(text) > scale, text).otherwise(F.lpad(text, scale + 1, "0"))
    size = F.length(text) - scale
    behind = F.concat(F.substring(text, F.lit(1), size), F.lit("."), F.substring(text, size + 1, scale))
    return F.when(scale > 0, behind).otherwise(text)


def _coerce(text: Column, data_type: str) -> Value:
    if data_type == "number":
        return Value(text, is_number(text), number_text(text))
    if data_type == "boolean":
        bare = F.coalesce(text.rlike(BOOLEAN), F.lit(False))
        return Value(text, bare, F.lower(F.regexp_replace(text, "[^A-Za-z]", "")))
    return Value(text)


def _native(column: Column, data_type: T.DataType) -> Value:
    text = text_of(column, data_type)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return Value(F.replace(text, F.lit(" "), F.lit("T")))
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        return Value(text, column.isNotNull(), F.to_json(column))
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        finite = column.isNotNull() & ~F.isnan(column) & (F.abs(column) != float("inf"))
        return Value(text, finite, text, data_type)
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return Value(text, column.isNotNull(), text, data_type)
    return Value(text)
