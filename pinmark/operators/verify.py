"""Verification: compare what a function does now with what its expectations pin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import unquoted
from ..schema import CASE_KEY, OUTCOME_COLUMNS, SUCCESS
from .ordering import top_k

# pytest's documented default tolerances of approx.
RELATIVE, ABSOLUTE = 1e-6, 1e-12


def assert_equal(exp_key: Column, act_key: Column) -> Column:
    """Python ``==``. A NULL key marks a value that holds NaN and equals nothing."""
    return F.coalesce(exp_key == act_key, F.lit(False))


def assert_bool(exp_key: Column, act_key: Column, act_type: Column) -> Column:
    """Identity with True or False: 1 is not True."""
    return F.coalesce((act_type == "bool") & (exp_key == act_key), F.lit(False))


def assert_approx(expected: Column, actual: Column) -> Column:
    """Within the default tolerance; infinities must be equal, NaN never is."""
    # Spark sorts NaN above all numbers, so comparisons must not see one.
    comparable = ~F.isnan(expected) & ~F.isnan(actual)
    finite = F.abs(expected) < float("inf")
    near = F.abs(actual - expected) <= F.greatest(F.abs(expected) * RELATIVE, F.lit(ABSOLUTE))
    return F.coalesce(comparable & ((expected == actual) | (finite & near)), F.lit(False))


def assert_nan(actual: Column) -> Column:
    return F.coalesce(F.isnan(actual), F.lit(False))


def assert_member(source_keys: Column, source_text: Column, act_key: Column, act_type: Column) -> Column:
    """In the list, or part of the string, that the output was drawn from."""
    in_list = F.array_contains(source_keys, act_key)
    in_text = (act_type == "string") & F.contains(source_text, unquoted(act_key))
    return F.coalesce(F.when(source_keys.isNotNull(), in_list).otherwise(in_text), F.lit(False))


def assert_not_null(act_type: Column) -> Column:
    return F.coalesce(act_type != "null", F.lit(False))


def assert_raises(error_class: Column, act_mro: Column) -> Column:
    """The expected class or one derived from it."""
    return F.coalesce(F.array_contains(act_mro, error_class), F.lit(False))


def assert_same(exp_hash: Column, exp_key: Column, act_hash: Column, act_key: Column) -> Column:
    """The whole value is the same, however long it is and whatever it holds: NaN is like NaN."""
    return F.coalesce(F.coalesce(exp_hash, exp_key) == F.coalesce(act_hash, act_key), F.lit(False))


def judge(cases: DataFrame, prefix: str = "act_", exact: bool = False) -> DataFrame:
    """Add ``passed`` and ``reason`` to expectations that have their actual outcome beside them.

    ``exact``, for deterministic functions, asks successful calls for the same whole value instead of the assertion: no
    tolerance, no membership, and long outputs by their hash. Booleans stay booleans.
    """
    act = {c: F.col(prefix + c) for c in OUTCOME_COLUMNS}
    ran = act["status"].isNotNull()
    succeeded = act["status"] == SUCCESS
    raises = F.col("assertion") == "raises"
    holds = (
        F.when(F.col("assertion") == "equal", assert_equal(F.col("exp_key"), act["out_key"]))
        .when(F.col("assertion") == "approx", assert_approx(F.col("exp_double"), act["out_double"]))
        .when(F.col("assertion") == "is_bool", assert_bool(F.col("exp_key"), act["out_key"], act["out_type"]))
        .when(
            F.col("assertion") == "member",
            assert_member(F.col("source_keys"), F.col("source_text"), act["out_key"], act["out_type"]),
        )
        .when(F.col("assertion") == "approx_nan", assert_nan(act["out_double"]))
        .when(F.col("assertion") == "not_null", assert_not_null(act["out_type"]))
        .otherwise(F.lit(False))
    )
    if exact:
        same = assert_same(F.col("exp_hash"), F.col("exp_key"), act["out_hash"], act["out_key"])
        holds = same & ((F.col("assertion") != "is_bool") | F.coalesce(act["out_type"] == "bool", F.lit(False)))
    # Only where several captures of a case were compared.
    ambiguous, settled = (F.col(prefix + c) if prefix + c in cases.columns else F.lit(False) for c in ("ambiguous", "settled"))
    reason = (
        F.when(~ran, F.lit("missing"))
        .when(ambiguous, F.lit("ambiguous"))
        .when(settled, F.lit("ok"))
        .when(raises & succeeded, F.lit("did_not_raise"))
        .when(raises & assert_raises(F.col("error_class"), act["error_mro"]), F.lit("ok"))
        .when(raises, F.lit("other_error"))
        .when(~succeeded, F.lit("unexpected_crash"))
        .when(holds, F.lit("ok"))
        .otherwise(F.lit("mismatch"))
    )
    return cases.withColumn("reason", reason).withColumn("passed", F.col("reason") == "ok")


# What expectations are filed under where a capture names no module or function.
_UNNAMED = {"module": "", "function": "unknown"}


def _filed(actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Captures under the names that their expectations have."""
    return actual.withColumns({c: F.coalesce(c, F.lit(_UNNAMED[c])) for c in keys if c in _UNNAMED})


def beside(expectations: DataFrame, actual: DataFrame, keys: Sequence[str] = CASE_KEY, prefix: str = "act_") -> DataFrame:
    """Pair each expectation with the fresh capture of the same case, if there is one.

    ``keys`` must be unique in ``actual`` (see ``duplicate_cases``). The key names one call, so its hash
    spreads even if one module holds most cases; a small side is broadcast by Spark on its measured size.
    """
    fresh = _filed(actual, keys).select(*keys, *[F.col(c).alias(prefix + c) for c in OUTCOME_COLUMNS])
    return expectations.join(fresh, list(keys), "left")


def _sums(hashed: str, key: str, side: str) -> list[Column]:
    """Mergeable sums that tell multisets of outcomes apart: what a call returned as a whole, or the class of its error."""
    outcome = F.xxhash64(F.coalesce(hashed, key), F.col("error_class"))
    return [
        F.count(F.lit(1)).alias(f"__{side}_n"),
        F.sum(outcome.cast("decimal(20,0)")).alias(f"__{side}_sum"),
        F.bit_xor(outcome).alias(f"__{side}_xor"),
        F.min(outcome).alias(f"__{side}_low"),
        F.max(outcome).alias(f"__{side}_high"),
    ]


def verify_repeated(
    expectations: DataFrame, actual: DataFrame, keys: Sequence[str] = CASE_KEY, exact: bool = False
) -> DataFrame:
    """``verify`` where ``keys`` need not name a single call: one result for each expectation, never more.

    Captures of a key that all did the same are one outcome, whatever their number. Where they differ, expectations and
    captures of the key are compared as multisets of outcomes: equal ones pass every case of the key, all others fail
    with the reason ``ambiguous``. Each side is reduced to one row of bounded size for a key, combined per task before it
    is exchanged, so a key may have any number of captures.
    """
    one = F.first(F.struct(*OUTCOME_COLUMNS)).alias("__one")
    fresh = _filed(actual, keys).groupBy(*keys).agg(*_sums("out_hash", "out_key", "act"), one)
    asked = expectations.groupBy(*keys).agg(*_sums("exp_hash", "exp_key", "exp"))
    alike = F.col("__act_low") == F.col("__act_high")
    equal = F.lit(True)
    for part in ("n", "sum", "xor"):
        equal = equal & (F.col(f"__exp_{part}") == F.col(f"__act_{part}"))
    met = asked.join(fresh, list(keys)).select(
        *keys,
        *[F.col(f"__one.{c}").alias("act_" + c) for c in OUTCOME_COLUMNS],
        (~alike & ~equal).alias("act_ambiguous"),
        (~alike & equal).alias("act_settled"),
    )
    return judge(expectations.join(met, list(keys), "left"), exact=exact)


def verify(
    expectations: DataFrame,
    actual: DataFrame,
    keys: Sequence[str] = CASE_KEY,
    suite: str | None = None,
    exact: bool = False,
) -> DataFrame:
    """Every expectation with ``passed`` and ``reason``; ``suite`` restricts to one module on both sides.

    ``keys`` must be unique in ``actual``; ``verify_repeated`` asks for nothing of the kind.
    """
    if suite is not None:
        expectations = expectations.where(F.col("module") == suite)
        actual = actual.where(F.col("module") == suite)
    return judge(beside(expectations, actual, keys), exact=exact)


def unmatched_actuals(actual: DataFrame, expectations: DataFrame, keys: Sequence[str] = CASE_KEY) -> DataFrame:
    """Captures no expectation covers."""
    return _filed(actual, keys).join(expectations.select(*keys), list(keys), "left_anti")


def duplicate_cases(df: DataFrame, keys: Sequence[str] = CASE_KEY) -> DataFrame:
    """Keys that do not name a single case; must be empty before a join on them is trusted."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def failure_sample(results: DataFrame, k: int) -> DataFrame:
    """The first ``k`` failing cases of each module."""
    failed = results.where(~F.col("passed"))
    return top_k(failed, ["module"], ["function", "case_kind", "seq", "case_name"], k)
