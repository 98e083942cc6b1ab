"""The library's main use: does a rewrite still behave like the function it replaces?"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import python_type
from ..operators.capture import Outcome, capture_native, replay, with_outcome
from ..operators.expect import derive_expectations
from ..operators.rollup import suite_rollup
from ..operators.verify import judge, verify


def compare_native(
    rows: DataFrame,
    baseline: Outcome,
    candidate: Outcome,
    args: Sequence[Column],
    *,
    module: str | Column,
    function: str,
    seq: Column,
    exact: bool = False,
) -> DataFrame:
    """Judge two column implementations row by row.

    Both are captured on the same row, the first becomes the expectation of the second. No key, no join, no shuffle:
    the cost is one scan of the argument columns, however large the table is. ``exact``, for deterministic functions,
    asks for equal outputs instead of the assertion that the capture would be pinned by: whole values are compared by
    their hash, however long they are, and NaN is like NaN.
    """
    beside = with_outcome(rows, candidate, args)
    fresh = [c for c in beside.columns if c not in rows.columns]
    captured = capture_native(beside, baseline, args, module=module, function=function, seq=seq, keep=fresh)
    if exact:
        cases = derive_expectations(captured, index=False, plain=True, keep=[*fresh, "out_type"])
        judged = judge(cases, exact=True)
        # A truth value is no number here.
        kinds = (F.col("out_type") == "bool") == (F.col("act_out_type") == "bool")
        reason = F.when((F.col("reason") == "ok") & ~F.coalesce(kinds, F.lit(True)), F.lit("mismatch")).otherwise(F.col("reason"))
        return judged.withColumn("reason", reason).withColumn("passed", F.col("reason") == "ok").drop("out_type")
    typed = rows.withColumns(dict(baseline.given)) if baseline.given else rows
    types = typed.select(baseline.value, *args).schema
    output, *inputs = (python_type(f.dataType) for f in types)
    plain = output in ("bool", "int", "float") and "list" not in inputs
    return judge(derive_expectations(captured, index=False, plain=plain, keep=fresh))


def replay_python(expectations: DataFrame, functions: Mapping[str | tuple[str, str], Callable]) -> DataFrame:
    """Judge Python functions against stored expectations by calling them on the stored arguments."""
    return judge(replay(expectations, functions))


def verify_store(
    spark: SparkSession, table: str, fresh: DataFrame, suites: DataFrame | None = None, exact: bool = False
) -> DataFrame:
    """Verdict per suite of all stored suites against fresh captures of any number of modules, in one job.

    The table is bucketed by the case key, so only the fresh captures are exchanged, whatever the number and size of the
    suites; a module with most of the cases is spread over all buckets. ``suites`` (column ``module``) lists what was asked
    for: other suites are left out, and one that is not stored is an ERROR.
    """
    results = verify(spark.table(table), fresh, exact=exact)
    return suite_rollup(results, suites)


def replay_store(
    spark: SparkSession, table: str, functions: Mapping[str | tuple[str, str], Callable], suites: DataFrame | None = None
) -> DataFrame:
    """Verdict per suite by calling functions on the arguments the suites hold; nothing but partial counts is exchanged.

    ``functions`` by (module, name) where modules share a name.
    """
    return suite_rollup(replay_python(spark.table(table), functions), suites)
