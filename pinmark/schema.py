"""Table shapes shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())

# What one call did: the three groups below are reused by replay, which only adds the outcome to an expectation.
IDENTITY_FIELDS = [
    T.StructField("module", T.StringType()),
    T.StructField("function", T.StringType()),
    T.StructField("seq", T.LongType()),
]
ARGUMENT_FIELDS = [
    T.StructField("arg_json", _STRINGS),
    T.StructField("arg_keys", _STRINGS),
    T.StructField("arg_elem_keys", T.ArrayType(_STRINGS)),
    # What JSON has no form for: decimal, date, timestamp, binary; NULL for all other arguments.
    T.StructField("arg_types", _STRINGS),
]
OUTCOME_FIELDS = [
    T.StructField("status", T.StringType()),
    T.StructField("out_type", T.StringType()),
    T.StructField("out_json", T.StringType()),
    T.StructField("out_key", T.StringType()),
    T.StructField("out_double", T.DoubleType()),
    T.StructField("out_len", T.IntegerType()),
    T.StructField("out_digest", T.StringType()),
    # SHA-256 of the whole identity key, NaN like NaN, of outputs without an equality key: long ones, and those with NaN.
    T.StructField("out_hash", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("error_class", T.StringType()),
    T.StructField("error_mro", _STRINGS),
    T.StructField("traceback", T.StringType()),
]

CAPTURES = T.StructType(IDENTITY_FIELDS + ARGUMENT_FIELDS + OUTCOME_FIELDS)
CAPTURE_COLUMNS = CAPTURES.fieldNames()
OUTCOME_COLUMNS = [f.name for f in OUTCOME_FIELDS]

EXPECTATIONS = T.StructType(
    IDENTITY_FIELDS
    + [
        T.StructField("case_kind", T.StringType()),
        T.StructField("case_idx", T.LongType()),
        T.StructField("case_name", T.StringType()),
    ]
    + [f for f in ARGUMENT_FIELDS if f.name != "arg_elem_keys"]
    + [
        T.StructField("assertion", T.StringType()),
        T.StructField("exp_json", T.StringType()),
        T.StructField("exp_key", T.StringType()),
        T.StructField("exp_hash", T.StringType()),
        T.StructField("exp_double", T.DoubleType()),
        T.StructField("source_keys", _STRINGS),
        T.StructField("source_text", T.StringType()),
        T.StructField("error_class", T.StringType()),
    ]
)
EXPECTATION_COLUMNS = EXPECTATIONS.fieldNames()

# What names an output whole: its equality key, or the hash where it has none.
IDENTITY = ("out_hash", "out_key")

# A case is identified by its place among the probe inputs; the status is part of the outcome, never of the key.
CASE_KEY = ("module", "function", "seq")
# For deterministic functions over tables without a unique row key: the argument tuple itself.
ARGUMENT_KEY = ("module", "function", "arg_keys")

SUCCESS, CRASHED = "success", "crashed"
