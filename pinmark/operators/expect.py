"""Expectations: classify each capture into the assertion that pins it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import unquoted
from ..schema import EXPECTATION_COLUMNS, IDENTITY, SUCCESS
from .ordering import dense_index, numbered

ASSERTIONS = ("not_null", "member", "approx", "approx_nan", "is_bool", "equal", "raises")


def error_class(error: Column) -> Column:
    """Class part of ``Class: message``; a text without ``": "`` is taken whole, no text means ``Exception``."""
    text = F.coalesce(error, F.lit(""))
    return (
        F.when(F.contains(text, F.lit(": ")), F.trim(F.split_part(text, F.lit(":"), F.lit(1))))
        .when(text != "", F.trim(text))
        .otherwise(F.lit("Exception"))
    )


def error_message(error: Column) -> Column:
    text = F.coalesce(error, F.lit(""))
    after = F.trim(F.substring(text, F.locate(":", text) + 1, F.length(text)))
    return F.when(F.contains(text, F.lit(": ")), after).otherwise(F.lit(""))


def case_name(function: Column, kind: Column, index: Column) -> Column:
    return F.concat(F.lit("test_"), function, F.lit("_"), kind, F.lit("_"), index.cast("string"))


def is_digest(text: Column) -> Column:
    """Whether an output text is a stand-in for something too long to compare."""
    return F.coalesce(
        F.startswith(text, F.lit("[list of ")) | F.contains(text, F.lit("[truncated]")) | (F.length(text) > 500),
        F.lit(False),
    )


def _holds_digest(out_type: Column, out_json: Column, out_digest: Column) -> Column:
    # A string's JSON text opens with a quote; brackets and letters are never escaped.
    looks_like = F.startswith(out_json, F.lit('"[list of ')) | F.contains(out_json, F.lit("[truncated]"))
    textual = out_type.isin("string", "list", "dict", "other")
    return out_digest.isNotNull() | (textual & F.coalesce(looks_like, F.lit(False)))


def member_of(arg_keys: Column, arg_elem_keys: Column, out_key: Column) -> Column:
    """1-based place of the first argument the output is a member of, 0 if none.

    A list argument holds an element equal to the output, or a string argument holds the output, which must be a string
    of one character.
    """
    inner = unquoted(out_key)
    one_char = F.startswith(out_key, F.lit('"')) & ((F.length(inner) == 1) | inner.isin("\\\\", '\\"'))

    def hit(key: Column, place: Column) -> Column:
        elements = F.get(arg_elem_keys, place)
        return F.coalesce(
            F.when(elements.isNotNull(), F.array_contains(elements, out_key)).otherwise(
                one_char & F.startswith(key, F.lit('"')) & F.contains(unquoted(key), inner)
            ),
            F.lit(False),
        )

    return F.array_position(F.transform(arg_keys, hit), True).cast("int")


def varying_calls(captures: DataFrame) -> DataFrame:
    """Calls whose repeated captures do not all agree on the whole output, however long it is; NaN agrees with NaN."""
    whole = F.xxhash64(F.coalesce(*IDENTITY), F.col("status"))
    captured = captures.where(F.col("status").eqNullSafe(SUCCESS))
    calls = captured.groupBy("module", "function", "arg_keys").agg(F.min(whole).alias("__low"), F.max(whole).alias("__high"))
    varies = F.col("__low") != F.col("__high")
    return calls.where(varies).select("module", "function", "arg_keys", F.lit(True).alias("__varies"))


def derive_expectations(
    captures: DataFrame, *, index: bool = True, strict: bool = False, plain: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """One expectation per capture; the first rule that fits wins.

    Success: digest -> ``not_null``; member of an argument -> ``member``; float -> ``approx`` (NaN: ``approx_nan``);
    bool -> ``is_bool``; anything else -> ``equal``. Crash -> ``raises``.

    ``index`` numbers cases per (module, function, kind) in capture order and costs an exchange; without it the step is
    narrow and ``seq`` alone names the case. ``strict`` weakens to ``member`` only calls that were captured at least
    twice with different outputs, which spares deterministic functions whose result happens to be in their input.
    ``plain`` states that outputs are numbers or booleans and no argument is a list, so that neither a digest nor a
    membership can occur; texts and argument keys are then not even computed.

    Numbering and ``strict`` read the captures more than once: give them stored ones if the function is not
    deterministic or expensive.
    """
    if strict:
        captures = captures.join(varying_calls(captures), ["module", "function", "arg_keys"], "left")
        may_vary = F.coalesce("__varies", F.lit(False))
    else:
        may_vary = F.lit(True)

    ok = F.col("status").eqNullSafe(SUCCESS)
    digest = _holds_digest(F.col("out_type"), F.col("out_json"), F.col("out_digest"))
    # Only these can be members; asking first keeps the array functions away from most rows.
    askable = F.col("out_key").isNotNull() & (
        F.startswith("out_key", F.lit('"')) | F.exists("arg_elem_keys", lambda e: e.isNotNull())
    )
    place = F.when(
        ok & ~digest & may_vary & askable, member_of(F.col("arg_keys"), F.col("arg_elem_keys"), F.col("out_key"))
    ).otherwise(F.lit(0))

    if plain:
        digest, place = F.lit(False), F.lit(0)

    staged = captures.withColumns(
        {
            "__module": F.coalesce("module", F.lit("")),
            "__function": F.coalesce("function", F.lit("unknown")),
            "__kind": F.when(ok, F.lit("success")).otherwise(F.lit("crash")),
            "__digest": digest,
            "__place": place,
        }
    )
    is_float = F.col("out_type") == "float"
    assertion = (
        F.when(~ok, F.lit("raises"))
        .when(F.col("__digest"), F.lit("not_null"))
        .when(F.col("__place") > 0, F.lit("member"))
        .when(is_float & F.isnan("out_double"), F.lit("approx_nan"))
        .when(is_float, F.lit("approx"))
        .when(F.col("out_type") == "bool", F.lit("is_bool"))
        .otherwise(F.lit("equal"))
    )
    source = F.get("arg_keys", F.col("__place") - 1)
    from_list = F.get("arg_elem_keys", F.col("__place") - 1)
    member = F.col("__place") > 0
    cases = staged.select(
        F.col("__module").alias("module"),
        F.col("__function").alias("function"),
        "seq",
        F.col("__kind").alias("case_kind"),
        "arg_json",
        "arg_keys",
        "arg_types",
        assertion.alias("assertion"),
        F.col("out_json").alias("exp_json"),
        F.col("out_key").alias("exp_key"),
        F.col("out_hash").alias("exp_hash"),
        F.col("out_double").alias("exp_double"),
        F.when(member, from_list).alias("source_keys"),
        F.when(member & from_list.isNull(), unquoted(source)).alias("source_text"),
        F.when(~ok, F.coalesce("error_class", error_class(F.col("error")))).alias("error_class"),
        *keep,
    )
    if index:
        cases = dense_index(cases, ["module", "function", "case_kind"], "seq", "case_idx")
        number = F.col("case_idx")
    else:
        cases = cases.withColumn("case_idx", F.lit(None).cast("bigint"))
        number = F.col("seq")
    return cases.withColumn("case_name", case_name(F.col("function"), F.col("case_kind"), number)).select(
        *EXPECTATION_COLUMNS, *keep
    )


def with_seq(captures: DataFrame, order: Sequence[Column | str] = ()) -> DataFrame:
    """Give captures without ``seq`` their position, by ``order`` or as they are read: then they are cases with a key.

    Positions run over all modules, which is as good: ``case_idx`` counts within its own group. See ``ordering.numbered``.
    """
    rest = [c for c in captures.columns if c != "seq"]
    return numbered(captures.select(*rest), "seq", order).select(*captures.columns)


def override_cases(auto: DataFrame, manual: DataFrame, keys=("module", "case_name")) -> DataFrame:
    """Hand-written cases replace derived ones of the same name."""
    return manual.unionByName(auto.join(manual.select(*keys).distinct(), list(keys), "left_anti"))
