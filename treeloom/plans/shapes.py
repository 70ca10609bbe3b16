"""Stripping and flattening of records of any shape: what an export's compiler does by pruning its tree, for frames and
JSON documents that were not compiled here.

The schema is walked when the query is planned, through structs, arrays and maps. A VARIANT has no schema: it is stripped
value by value, and flattened by the schema that one aggregation finds in all of its values.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.definition import DEFAULT_DENYLIST, DefinitionError
from treeloom.functions.text import text_of

MOST_COLUMNS = 5_000


def strip_any(rows: DataFrame, denylist: Iterable[str] = DEFAULT_DENYLIST) -> DataFrame:
    """``rows`` without any column, field, map entry or VARIANT key on the denylist, in any case and at every depth, whole
    subtrees included. What has no such name is passed on untouched; a VARIANT is rewritten through its JSON text."""
    denied = frozenset(name.lower() for name in denylist)
    kept = [field for field in rows.schema if field.name.lower() not in denied]
    return rows.select(*[_stripped(_column(field.name), field.dataType, denied).alias(field.name) for field in kept])


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _concerned(kind: T.DataType, denied: frozenset[str]) -> bool:
    """Whether values of this type may hold a denied name."""
    if isinstance(kind, T.StructType):
        return any(field.name.lower() in denied or _concerned(field.dataType, denied) for field in kind)
    if isinstance(kind, T.ArrayType):
        return _concerned(kind.elementType, denied)
    return isinstance(kind, (T.MapType, T.VariantType))


def _stripped(column: Column, kind: T.DataType, denied: frozenset[str]) -> Column:
    if not _concerned(kind, denied):
        return column
    if isinstance(kind, T.StructType):
        fields = [field for field in kind if field.name.lower() not in denied]
        return F.when(column.isNotNull(), F.struct(*[_stripped(column[f.name], f.dataType, denied).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda one: _stripped(one, kind.elementType, denied))
    if isinstance(kind, T.MapType):
        if isinstance(kind.keyType, T.StringType):
            column = F.map_filter(column, lambda key, _: ~F.lower(key).isin(*denied))
        if not _concerned(kind.valueType, denied):
            return column
        return F.transform_values(column, lambda _, value: _stripped(value, kind.valueType, denied))
    return F.parse_json(_json_stripper(denied)(F.to_json(column)))


def _json_stripper(denied: frozenset[str]):
    def without(value):
        if isinstance(value, dict):
            return {key: without(inner) for key, inner in value.items() if key.lower() not in denied}
        return [without(inner) for inner in value] if isinstance(value, list) else value

    @F.pandas_udf("string")
    def stripped(documents: pd.Series) -> pd.Series:
        # Numbers keep their digits: they are read as their own text.
        read = json.JSONDecoder(parse_float=_Digits, parse_int=_Digits).decode
        return documents.map(lambda text: None if text is None else _written(without(read(text))))

    return stripped


class _Digits(str):
    """A number as it was written."""


def _written(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(key)}:{_written(inner)}" for key, inner in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    return str(value) if isinstance(value, _Digits) else json.dumps(value)


# --- flattening ---------------------------------------------------------------------------------


def flatten_any(rows: DataFrame, keys: Iterable[str] = (), delimiter: str = ", ") -> DataFrame:
    """``keys`` as they are, then one text column for each path to a value in the other columns, named with dots.

    A path through an array gives one value for each element; nulls are left out and the rest is joined. A missing
    value is an empty text. Maps and VARIANTs are objects whose names are those found in any row, in order.
    """
    keys = list(keys)
    rows = _typed(rows, keys)
    columns = []
    for field in rows.schema:
        if field.name not in keys:
            columns += [(path, _column(field.name), field.dataType) for path in _paths(field.dataType, (field.name,))]
    if len(columns) > MOST_COLUMNS:
        raise DefinitionError(f"{len(columns)} columns are more than {MOST_COLUMNS}")
    names = [".".join(path) for path, _, _ in columns]
    if len(set(names)) < len(names):
        raise DefinitionError("two paths have the same name")
    texts = [_joined(column, kind, path[1:], delimiter).alias(name) for name, (path, column, kind) in zip(names, columns)]
    return rows.select(*[_column(key) for key in keys], *texts)


def _is_open(kind: T.DataType) -> bool:
    """Whether the names inside are known from values only."""
    if isinstance(kind, T.StructType):
        return any(_is_open(field.dataType) for field in kind)
    if isinstance(kind, T.ArrayType):
        return _is_open(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType))


def _typed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Columns with maps or VARIANTs as structs, by the schemas that one pass over them finds."""
    found = {field.name: field.dataType for field in rows.schema if field.name not in keys and _is_open(field.dataType)}
    if not found:
        return rows
    free = {name: _column(name) if isinstance(kind, T.VariantType) else F.to_variant_object(_column(name)) for name, kind in found.items()}
    schemas = rows.agg(*[F.schema_of_variant_agg(column).alias(f"s{at}") for at, column in enumerate(free.values())]).first()
    typed = {name: F.try_variant_get(column, "$", _ddl(schema)) for (name, column), schema in zip(free.items(), schemas)}
    return rows.select(*[typed.get(name, _column(name)).alias(name) for name in rows.columns])


def _ddl(schema: str) -> str:
    """A VARIANT's schema as a type of columns; back-quoted names are left alone."""
    parts = re.split("(`(?:[^`]|``)*`)", schema)
    plain = [re.sub(r"\bVOID\b", "STRING", re.sub(r"\bOBJECT<", "STRUCT<", part)) for part in parts[::2]]
    parts[::2] = plain
    return "".join(parts)


def _paths(kind: T.DataType, before: tuple[str, ...]) -> Iterable[tuple[str, ...]]:
    if isinstance(kind, T.ArrayType):
        yield from _paths(kind.elementType, before)
    elif isinstance(kind, T.StructType):
        for field in kind:
            yield from _paths(field.dataType, (*before, field.name))
    else:
        yield before


def _joined(column: Column, kind: T.DataType, path: tuple[str, ...], delimiter: str) -> Column:
    while path and isinstance(kind, T.StructType):
        column, kind, path = column[path[0]], kind[path[0]].dataType, path[1:]
    if not isinstance(kind, T.ArrayType):
        return F.coalesce(_text(column, kind), F.lit(""))
    return F.coalesce(F.array_join(_values(column, kind, path), delimiter), F.lit(""))


def _values(column: Column, kind: T.DataType, path: tuple[str, ...]) -> Column:
    """All values at the path as texts, without nulls; never null itself."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(column, lambda one: _values(one, kind.elementType, path))), none)
    if path:
        return _values(column[path[0]], kind[path[0]].dataType, path[1:])
    text = _text(column, kind)
    return F.when(text.isNotNull(), F.array(text)).otherwise(none)


def _text(column: Column, kind: T.DataType) -> Column:
    return column.cast("string") if isinstance(kind, T.VariantType) else text_of(column, kind)
