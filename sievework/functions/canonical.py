"""The canonical JSON of a record as a Column: compact, keys sorted, UTF-8 unescaped, byte for byte what Python's json gives.

Strings, integers, booleans, dates, timestamps, structs and arrays are JVM expressions. Only floating-point, decimal and
binary leaves, whose text Java spells otherwise, go through vectorised Python.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip as strip_text

_COMMON = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
_RARE = [("\b", "\\b"), ("\f", "\\f")] + [(chr(i), f"\\u{i:04x}") for i in range(32) if chr(i) not in "\n\r\t\b\f"]
#: How a record is spelled: UTF-8 as it is, no blanks, keys in order.
_COMPACT = {"sort_keys": True, "separators": (",", ":"), "ensure_ascii": False}
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_PYTHON = (T.FloatType, T.DoubleType, T.DecimalType, T.BinaryType)


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for raw, spelled in pairs:
        text = F.replace(text, F.lit(raw), F.lit(spelled))
    return text


def quoted(text: Column) -> Column:
    """A JSON string. Control characters other than line ends and tabs are rare, so their replacements are skipped for most."""
    common = _replaced(text, _COMMON)
    rare = text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    return F.concat(F.lit('"'), F.when(rare, _replaced(common, _RARE)).otherwise(common), F.lit('"'))


def _python_value(value, kind: pa.DataType, strip: bool):
    """A value as the JSON encoder takes it: what it has no type for becomes its ``str``."""
    if isinstance(value, str):
        return value.strip() if strip else value
    if value is None or isinstance(value, (bool, float, int)):
        return value
    if pa.types.is_map(kind):
        return {str(k): _python_value(v, kind.item_type, strip) for k, v in value}
    if pa.types.is_struct(kind):
        return {f.name: _python_value(value[f.name], f.type, strip) for f in kind}
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return [_python_value(v, kind.value_type, strip) for v in value]
    return str(value)


def _dumps(values: pa.Array, strip: bool) -> pa.Array:
    spelled = [None if v is None else json.dumps(_python_value(v, values.type, strip), **_COMPACT) for v in values.to_pylist()]
    return pa.array(spelled, pa.string())


def _double_json(values: pa.Array) -> pa.Array:
    spell = {math.inf: "Infinity", -math.inf: "-Infinity"}
    return pa.array([None if v is None else "NaN" if v != v else spell.get(v) or repr(v) for v in values.to_pylist()], pa.string())


def _exact_json(values: pa.Array) -> pa.Array:
    return _dumps(values, False)


def _stripped_json(values: pa.Array) -> pa.Array:
    return _dumps(values, True)


def _python(f: Callable[[pa.Array], pa.Array], value: Column) -> Column:
    """Vectorised, and made when it is used: a function object belongs to the context that it first ran in."""
    return F.arrow_udf(f, T.StringType())(value)


def _has(kind: T.DataType, kinds: tuple) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has(kind.elementType, kinds)
    if isinstance(kind, T.MapType):
        return _has(kind.keyType, kinds) or _has(kind.valueType, kinds)
    if isinstance(kind, T.StructType):
        return any(_has(f.dataType, kinds) for f in kind.fields)
    return isinstance(kind, kinds)


def python_str(value: Column, kind: T.DataType) -> Column:
    """``str(value)`` of a scalar column; null stays null."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        micros = F.date_format(value, "SSSSSS")
        text = F.concat(F.date_format(value, "yyyy-MM-dd HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))
        return F.concat(text, F.regexp_replace(F.date_format(value, "xxx"), "Z", "+00:00")) if isinstance(kind, T.TimestampType) else text
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        spelled = F.when(value.isNotNull(), _python(_double_json, value.cast("double")))
        return F.when(spelled == "NaN", "nan").otherwise(F.replace(spelled, F.lit("Infinity"), F.lit("inf")))
    if isinstance(kind, (T.DecimalType, T.BinaryType)):
        return F.get_json_object(F.concat(F.lit('{"v":'), _python(_exact_json, value), F.lit("}")), "$.v")
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return json_of(value, kind, False)
    return value.cast("string")


def json_of(value: Column, kind: T.DataType, strip: bool) -> Column:
    """The JSON text of a value; a null gives ``null``. Strings are stripped on request, keys never."""
    if isinstance(kind, T.NullType):
        return F.lit("null")
    if isinstance(kind, T.StringType):
        out = quoted(strip_text(value) if strip else value)
    elif isinstance(kind, T.BooleanType) or isinstance(kind, _INTEGERS):
        out = value.cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = F.when(value.isNotNull(), _python(_double_json, value.cast("double")))
    elif isinstance(kind, (T.DecimalType, T.BinaryType)):
        out = _python(_exact_json, value)
    elif isinstance(kind, T.StructType):
        parts = []
        for i, f in enumerate(sorted(kind.fields, key=lambda f: f.name)):
            parts += [F.lit(("," if i else "") + json.dumps(f.name, ensure_ascii=False) + ":"), json_of(value.getField(f.name), f.dataType, strip)]
        out = F.when(value.isNotNull(), F.concat(F.lit("{"), *parts, F.lit("}")))
    elif isinstance(kind, (T.ArrayType, T.MapType)) and _has(kind, _PYTHON):
        out = _python(_stripped_json if strip else _exact_json, value)  # Python functions can't run inside of an array's lambda
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_of(x, kind.elementType, strip)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        spelled = F.transform(entries, lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(":"), json_of(e["value"], kind.valueType, strip)))
        out = F.concat(F.lit("{"), F.array_join(spelled, ","), F.lit("}"))
    else:
        out = quoted(python_str(value, kind))
    return F.coalesce(out, F.lit("null"))


def record_json(df: DataFrame, strip: bool, columns: list[str] | None = None) -> Column:
    """All fields of a record (or those named), null ones included."""
    names = sorted(df.columns if columns is None else columns)
    parts = [F.lit("{")]
    for i, name in enumerate(names):
        parts += [F.lit(("," if i else "") + json.dumps(name, ensure_ascii=False) + ":"), json_of(column(name), df.schema[name].dataType, strip)]
    return F.concat(*parts, F.lit("}"))


def record_digest(df: DataFrame, strip: bool, columns: list[str] | None = None) -> Column:
    return F.sha2(record_json(df, strip, columns), 256)


def text_digest(text: Column, strip: bool) -> Column:
    """The digest of a record whose only field is ``text``."""
    return F.sha2(F.concat(F.lit('{"text":'), quoted(strip_text(text) if strip else text), F.lit("}")), 256)
