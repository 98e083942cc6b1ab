"""Probe inputs: argument tuples to call a function with, as JSON texts per argument."""

from __future__ import annotations

import ast
import json
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import python_float_text, python_strip
from .ordering import below_kth, top_k

_STRICT_JSON = {"allowSingleQuotes": "false"}


def default_inputs(n_args: Column) -> Column:
    """One empty call for a function without arguments, else all zeros, all ones, all minus ones."""
    constant = F.transform(F.array(F.lit("0"), F.lit("1"), F.lit("-1")), lambda v: F.array_repeat(v, n_args))
    none = F.array(F.array().cast("array<string>"))
    return F.when(n_args == 0, none).otherwise(constant)


def _exploded(df: DataFrame, inputs: Column, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.posexplode(inputs).alias("case_seq", "arg_json"))


def default_probes(functions: DataFrame, keep: Sequence[str] = ("module", "function")) -> DataFrame:
    return _exploded(functions, default_inputs(F.size("args")), keep)


def _is_list(item: Column) -> Column:
    return F.startswith(F.schema_of_variant(item), F.lit("ARRAY"))


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _json(value: Column, depth: int = 2) -> Column:
    """JSON text of a VARIANT that keeps floats apart from integers, down to ``depth`` levels of lists; see ``_deep``."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    whole = kind.rlike(r"^DECIMAL\((\d|1[0-8]),0\)$")
    text = (
        F.when(whole, F.concat(F.to_json(value), F.lit(".0")))
        .when((kind == "DOUBLE") & F.isnan(number), F.lit("NaN"))
        .when((kind == "DOUBLE") & (number == float("inf")), F.lit("Infinity"))
        .when((kind == "DOUBLE") & (number == float("-inf")), F.lit("-Infinity"))
        .when(kind == "DOUBLE", python_float_text(number))
    )
    if depth:
        listed = F.transform(_items(value), lambda e: _json(e, depth - 1))
        text = text.when(_is_list(value), F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")))
    return text.otherwise(F.to_json(value))


def _text(value) -> str:
    """JSON text of any value a VARIANT holds: decimals with a fraction are floats, those without are large integers."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_text(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(map(_text, value)) + "]"
    if isinstance(value, Decimal):
        return repr(float(value)) if value.as_tuple().exponent < 0 else str(value)
    return json.dumps(value, ensure_ascii=False, default=str)


def _nested_inputs(items: list | None, n_args: int | None) -> list[list[str]] | None:
    """``normalise_inputs`` of one row, for values nested to any depth."""
    if items is None:
        return None
    inputs = []
    try:
        for item in (i.toPython() for i in items if i is not None):
            if isinstance(item, list) and (len(item) == n_args or n_args != 1):
                inputs.append([_text(part) for part in item])
            elif n_args == 1:
                inputs.append([_text(item)])
    except RecursionError:
        return None
    return inputs


# What the columns below do not encode: objects, lists of mixed kinds inside a list, lists inside lists inside a list.
_DEEP = "OBJECT|VARIANT|ARRAY<ARRAY"


def _deep(raw: Column) -> Column:
    def of(value: Column) -> Column:
        return F.rlike(F.schema_of_variant(value), F.lit(_DEEP))

    found = F.exists(raw, lambda i: F.coalesce(F.when(_is_list(i), F.exists(_items(i), of)).otherwise(of(i)), F.lit(False)))
    return F.coalesce(found, F.lit(False))


def normalise_inputs(raw: Column, n_args: Column) -> Column:
    """Argument tuples from a VARIANT list whose elements may be tuples, single arguments or stray scalars.

    A list of the right length is a tuple; any other value is the argument of a one-argument function. For more
    arguments other lists are kept as they are (the call will fail and be recorded) and scalars are dropped. Rows that
    hold objects or deeper lists are encoded in Arrow batches, value by value; all others pass that step as NULLs.
    """
    deep = _deep(raw)
    nested = F.udf(_nested_inputs, "array<array<string>>", useArrow=True).asNondeterministic()
    return F.coalesce(nested(F.when(deep, raw), F.when(deep, n_args.cast("int"))), _flat_inputs(raw, n_args))


def _flat_inputs(raw: Column, n_args: Column) -> Column:

    # The parts of a list are taken out once and used in every rule.
    tagged = F.transform(
        raw, lambda i: F.struct(i.alias("item"), F.when(_is_list(i), _items(i)).alias("parts"))
    )

    def normal(tagged_item: Column) -> Column:
        item, parts = tagged_item["item"], tagged_item["parts"]
        texts = F.transform(parts, lambda e: _json(e))
        return (
            F.when(F.size(parts) == n_args, texts)
            .when(n_args == 1, F.array(_json(item)))
            .when(parts.isNotNull(), texts)
        )

    return F.filter(F.transform(tagged, normal), lambda t: t.isNotNull())


def parse_list(text: Column) -> Column:
    """A JSON list as VARIANT elements."""
    return F.from_json(text, "array<variant>", _STRICT_JSON)


def literal_to_json(text: str | None) -> str | None:
    """JSON text of a Python literal."""
    if text is None:
        return None
    try:
        return json.dumps(ast.literal_eval(text), default=str)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


def strip_fences(text: Column) -> Column:
    bare = python_strip(text)
    for mark in ("^```json", "^```", "```$"):
        bare = F.regexp_replace(bare, mark, "")
    return python_strip(bare)


def _as_list(text: str) -> Column:
    """Values in a text; exactly one if the text is JSON."""
    return F.from_json(F.concat(F.lit("["), F.col(text), F.lit("]")), "array<variant>", _STRICT_JSON)


def extract_inputs(responses: DataFrame, text: str = "response", n_args: str = "n_args") -> DataFrame:
    """Add ``inputs`` (argument tuples) and ``fallback`` to model responses.

    Code fences go; the rest is JSON or else a Python literal. The list is under ``test_inputs``, or the first list in
    the object, or the text itself. Responses without a non-empty list get the default inputs. Only texts that are not
    JSON reach the Python parser; the others pass it as NULLs.
    """
    read = F.udf(literal_to_json, "string", useArrow=True).asNondeterministic()
    is_json = F.coalesce(F.size("__listed") == 1, F.lit(False))
    bare = responses.withColumn("__text", strip_fences(F.col(text))).withColumn("__listed", _as_list("__text"))
    read_texts = bare.withColumn("__literal", read(F.when(~is_json, F.col("__text"))))
    # Each text is parsed once more at most: as a literal turned into JSON.
    values = read_texts.withColumns(
        {
            "__json": F.when(is_json, F.col("__text")).otherwise(F.col("__literal")),
            "__value": F.when(is_json, F.get("__listed", F.lit(0))).otherwise(F.get(_as_list("__literal"), F.lit(0))),
        }
    )
    named = F.try_variant_get("__value", "$.test_inputs", "variant")
    picked = values.withColumn("__named", F.when(~F.is_variant_null(named), named))
    # A map keeps the order of keys in the text.
    members = F.map_values(F.from_json("__json", "map<string,variant>", _STRICT_JSON))
    raw = (
        F.when(_is_list(F.col("__value")), _items(F.col("__value")))
        .when(F.col("__named").isNotNull(), _items(F.col("__named")))
        .otherwise(_items(F.get(F.filter(members, _is_list), F.lit(0))))
    )
    listed = picked.withColumn("__raw", raw)
    usable = F.coalesce(F.size("__raw") > 0, F.lit(False))
    return (
        listed.withColumn("fallback", ~usable)
        .withColumn(
            "inputs",
            F.when(usable, normalise_inputs(F.col("__raw"), F.col(n_args))).otherwise(default_inputs(F.col(n_args))),
        )
        .select(*responses.columns, "inputs", "fallback")
    )


def explode_inputs(inputs: DataFrame, keep: Sequence[str] = ("module", "function")) -> DataFrame:
    """One probe a row, as ``capture_probes`` takes them."""
    return _exploded(inputs, F.col("inputs"), keep)


def sample_probes(
    df: DataFrame, args: Sequence[str], strata: Sequence[str], k: int, order: Column | None = None
) -> DataFrame:
    """Distinct argument tuples per stratum: ``k`` of them in hash order, and those that hold a boundary.

    Boundaries of an argument are its minimum, maximum, NULL, and zero or empty text; of several tuples that hold one
    the smallest is taken (for the maximum the largest). Neither part makes the tuples of the table distinct: boundaries
    are found by one row per task and stratum, and ``below_kth`` leaves little more than ``k`` tuples of a stratum to sample
    from, which are made distinct. ``order`` must be a function of the arguments.
    """
    calls = df.select(*strata, *args)
    order = order if order is not None else F.xxhash64(*args)
    picked = top_k(below_kth(calls, strata, args, order, k).distinct(), strata, [order, *args], k)

    call = F.struct(*args)
    edges = []
    for a in args:
        dtype = df.schema[a].dataType
        keyed = F.when(F.col(a).isNotNull(), F.struct(a, call.alias("call")))
        edges += [F.min(keyed)["call"], F.max(keyed)["call"], F.min(F.when(F.col(a).isNull(), call))]
        if isinstance(dtype, T.StringType):
            edges.append(F.min(F.when(F.col(a) == "", call)))
        elif isinstance(dtype, T.NumericType):
            edges.append(F.min(F.when(F.col(a) == 0, call)))
    bounds = calls.groupBy(*strata).agg(F.array_compact(F.array(*edges)).alias("__edges"))
    boundary = bounds.select(*strata, F.explode("__edges").alias("__call")).select(*strata, "__call.*")
    return picked.unionByName(boundary).distinct()
