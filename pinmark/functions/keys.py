"""Typed columns to the untyped capture form: JSON text, equality keys and lengths, all inside the JVM.

The expression is built once from the column's Spark type, so nested arrays, maps and structs become nested
higher-order functions and nothing is serialised to Python.

Two keys exist. ``identity_key`` names a value, NaN included, and is used for arguments. ``equality_key`` follows
Python's ``==``: booleans equal 0/1, integral floats equal integers, map order is ignored, and a value that holds a
NaN anywhere equals nothing, itself included, so its key is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import json_string, json_string_length, python_float_text

_INT64 = float(2**63)


def python_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NullType):
        return "null"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.ArrayType):
        return "list"
    if isinstance(dtype, (T.MapType, T.StructType)):
        return "dict"
    return "other"


def may_hold_nan(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return may_hold_nan(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return may_hold_nan(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(may_hold_nan(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def other_text(value: Column, dtype: T.DataType) -> Column:
    """``str(value)`` for types JSON has no form for."""
    if isinstance(dtype, T.BinaryType):
        raise TypeError("binary values have no text form here; pass base64(...) or hex(...) of them")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        zone = "xxx" if isinstance(dtype, T.TimestampType) else ""
        whole = F.date_format(value, "SSSSSS") == "000000"
        return F.when(whole, F.date_format(value, f"yyyy-MM-dd HH:mm:ss{zone}")).otherwise(
            F.date_format(value, f"yyyy-MM-dd HH:mm:ss.SSSSSS{zone}")
        )
    return value.cast("string")


def other_key(value: Column, dtype: T.DataType) -> Column:
    """The same for keys: decimals without trailing zeros."""
    text = other_text(value, dtype)
    if isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        return F.regexp_replace(text, r"\.?0+$", "")
    return text


def type_name(dtype: T.DataType) -> str | None:
    """The type of an argument that its JSON text alone does not give back."""
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return "date" if isinstance(dtype, T.DateType) else None


def quoted_key(text: Column) -> Column:
    slashed = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit('"'), F.replace(slashed, F.lit('"'), F.lit('\\"')), F.lit('"'))


def unquoted(key: Column) -> Column:
    """The escaped text between the quotes of a string key.

    Escaping works per character, so one text is part of another exactly when their escaped forms are.
    """
    return F.substring(key, F.lit(2), F.length(key) - 2)


def _float_key(value: Column) -> Column:
    # xxhash64 of one 8-byte word is a bijection, hence an exact name for the bit pattern on both sides.
    bits = F.concat(F.lit("f"), F.hex(F.xxhash64(value)))
    # Whether it is whole goes first: that alone settles most numbers. NaN is above the upper bound.
    whole = (F.rint(value) == value) & (value < _INT64) & (value >= -_INT64)
    return F.when(whole, value.cast("bigint").cast("string")).when(F.isnan(value), F.lit("nan")).otherwise(bits)


def identity_key(value: Column, dtype: T.DataType) -> Column:
    kind = python_type(dtype)
    if kind == "null":
        return F.lit("null")
    if kind == "bool":
        key = F.when(value, F.lit("1")).otherwise(F.lit("0"))
    elif kind == "int":
        key = value.cast("string")
    elif kind == "float":
        key = _float_key(value.cast("double"))
    elif kind == "string":
        key = quoted_key(value)
    elif isinstance(dtype, T.ArrayType):
        parts = F.transform(value, lambda e: identity_key(e, dtype.elementType))
        key = F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    elif kind == "dict":
        key = F.concat(F.lit("{"), F.array_join(F.array_sort(_entries(value, dtype, identity_key)), ","), F.lit("}"))
    else:
        key = quoted_key(other_key(value, dtype))
    return F.when(value.isNull(), F.lit("null")).otherwise(key)


def _entries(value: Column, dtype: T.DataType, encode) -> Column:
    if isinstance(dtype, T.MapType):
        return F.transform(
            F.map_entries(value),
            lambda e: F.concat(
                quoted_key(e["key"].cast("string")), F.lit(":"), encode(e["value"], dtype.valueType)
            ),
        )
    return F.array(
        *[
            F.concat(quoted_key(F.lit(f.name)), F.lit(":"), encode(value[f.name], f.dataType))
            for f in dtype.fields
        ]
    )


def holds_nan(value: Column, dtype: T.DataType) -> Column:
    if not may_hold_nan(dtype):
        return F.lit(False)
    if isinstance(dtype, T.ArrayType):
        found = F.exists(value, lambda e: holds_nan(e, dtype.elementType))
    elif isinstance(dtype, T.MapType):
        found = F.exists(F.map_values(value), lambda e: holds_nan(e, dtype.valueType))
    elif isinstance(dtype, T.StructType):
        found = F.lit(False)
        for f in dtype.fields:
            found = found | holds_nan(value[f.name], f.dataType)
    else:
        found = F.isnan(value)
    return F.coalesce(found, F.lit(False))


def equality_key(value: Column, dtype: T.DataType) -> Column:
    key = identity_key(value, dtype)
    return F.when(~holds_nan(value, dtype), key) if may_hold_nan(dtype) else key


def element_keys(value: Column, dtype: T.DataType) -> Column:
    """Equality keys of a list's elements; NULL for anything that is not a list."""
    if not isinstance(dtype, T.ArrayType):
        return F.lit(None).cast("array<string>")
    return F.transform(value, lambda e: equality_key(e, dtype.elementType))


def json_text(value: Column, dtype: T.DataType) -> Column:
    kind = python_type(dtype)
    if kind == "null":
        return F.lit("null")
    if kind in ("bool", "int"):
        text = value.cast("string")
    elif kind == "float":
        wide = value.cast("double")
        text = (
            F.when(F.isnan(wide), F.lit("NaN"))
            .when(wide == float("inf"), F.lit("Infinity"))
            .when(wide == float("-inf"), F.lit("-Infinity"))
            .otherwise(python_float_text(wide))
        )
    elif kind == "string":
        text = json_string(value)
    elif isinstance(dtype, T.ArrayType):
        text = F.concat(
            F.lit("["), F.array_join(F.transform(value, lambda e: json_text(e, dtype.elementType)), ", "), F.lit("]")
        )
    elif isinstance(dtype, T.MapType):
        pairs = F.transform(
            F.map_entries(value),
            lambda e: F.concat(json_string(e["key"].cast("string")), F.lit(": "), json_text(e["value"], dtype.valueType)),
        )
        text = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    elif isinstance(dtype, T.StructType):
        pairs = F.array(
            *[
                F.concat(json_string(F.lit(f.name)), F.lit(": "), json_text(value[f.name], f.dataType))
                for f in dtype.fields
            ]
        )
        text = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    else:
        text = json_string(other_text(value, dtype))
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def json_length(value: Column, dtype: T.DataType) -> Column:
    """``len(json.dumps(value))`` with ASCII escapes; parts are measured one by one, no text of the whole is made."""
    kind = python_type(dtype)
    if kind == "string":
        total = json_string_length(value)
    elif isinstance(dtype, T.ArrayType):
        parts = F.aggregate(value, F.lit(2), lambda acc, e: acc + json_length(e, dtype.elementType))
        total = parts + _gaps(F.size(value))
    elif isinstance(dtype, T.MapType):
        parts = F.aggregate(
            F.map_entries(value),
            F.lit(2),
            lambda acc, e: acc + json_string_length(e["key"].cast("string")) + 2 + json_length(e["value"], dtype.valueType),
        )
        total = parts + _gaps(F.size(value))
    elif isinstance(dtype, T.StructType):
        total = F.lit(2) + _gaps(F.lit(len(dtype.fields)))
        for f in dtype.fields:
            total = total + json_string_length(F.lit(f.name)) + 2 + json_length(value[f.name], f.dataType)
    elif kind == "other":
        total = json_string_length(other_text(value, dtype))
    else:
        return F.length(json_text(value, dtype))
    return F.when(value.isNull(), F.lit(4)).otherwise(total)


def _gaps(n: Column) -> Column:
    """What the separators between ``n`` parts add."""
    return 2 * F.greatest(n - 1, F.lit(0))


# The shortest JSON text of a value by its kind: "1", "0.0", "true", and two quotes or brackets; "null" is longer or as long.
_SHORTEST = {"null": 4, "bool": 4, "int": 1, "float": 3}


def is_long(value: Column, dtype: T.DataType, length: Column, limit: int) -> Column:
    """Whether ``length``, that of the JSON text, exceeds ``limit``.

    Where the number of parts or characters alone says so, ``length`` is not evaluated: numbers have slow texts.
    """
    if isinstance(dtype, T.StringType):
        least = F.length(value) + 2
    elif isinstance(dtype, T.ArrayType):
        least = F.size(value) * (_SHORTEST.get(python_type(dtype.elementType), 2) + 2)
    elif isinstance(dtype, T.MapType):
        # A key has two quotes, a colon and a blank.
        least = F.size(value) * (_SHORTEST.get(python_type(dtype.valueType), 2) + 6)
    else:
        return length > limit
    return F.when(least > limit, F.lit(True)).otherwise(length > limit)


def as_double(value: Column, dtype: T.DataType) -> Column:
    if python_type(dtype) in ("bool", "int", "float"):
        return value.cast("int").cast("double") if isinstance(dtype, T.BooleanType) else value.cast("double")
    return F.lit(None).cast("double")


def digest(value: Column, dtype: T.DataType, long: Column, head: int = 200) -> Column:
    """Short stand-in for an output whose JSON text is ``long`` (``is_long``), NULL for others.

    Lists report their size, everything else the first ``head`` characters of its text (for maps and structs that is
    the JSON text).
    """
    if isinstance(dtype, T.ArrayType):
        short = F.concat(F.lit("[list of "), F.size(value).cast("string"), F.lit(" items]"))
    else:
        text = value if isinstance(dtype, T.StringType) else json_text(value, dtype)
        short = F.concat(F.left(text, F.lit(head)), F.lit("... [truncated]"))
    return F.when(long, short)
