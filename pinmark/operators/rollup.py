"""Counts and verdicts per function, per suite and in total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SUCCESS
from .ordering import top_k


def bucket_by_function(captures: DataFrame) -> DataFrame:
    """Successes and crashes per function, with the place the function was first seen."""
    ok = F.col("status").eqNullSafe(SUCCESS)
    return captures.groupBy("module", F.coalesce("function", F.lit("unknown")).alias("function")).agg(
        F.count_if(ok).alias("successes"), F.count_if(~ok).alias("crashes"), F.min("seq").alias("first_seq")
    )


def function_list(captures: DataFrame) -> DataFrame:
    """Functions of each module in first-seen order, as one text.

    Reduced to one row per function before names are put together.
    """
    seen = bucket_by_function(captures).groupBy("module").agg(
        F.array_sort(F.collect_list(F.struct("first_seq", "function"))).alias("seen")
    )
    names = F.transform("seen", lambda s: s["function"])
    return seen.select("module", F.array_join(names, ", ").alias("functions"))


def case_count(expectations: DataFrame) -> DataFrame:
    return expectations.groupBy("module").agg(F.count(F.lit(1)).alias("cases"))


def suite_rollup(results: DataFrame, suites: DataFrame | None = None) -> DataFrame:
    """Passed, failed and status per module; no case failed means PASSED, also with no case at all.

    ``suites`` (column ``module``) lists what was asked for; a suite without a single result is an ERROR without counts.
    Asked names and results are counted together, in one exchange of partial counts.
    """
    counts = [F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")]
    status = F.when(F.col("failed") == 0, F.lit("PASSED")).otherwise(F.lit("FAILED"))
    if suites is None:
        return results.groupBy("module").agg(*counts).withColumn("status", status)
    no, yes = F.lit(False), F.lit(True)
    asked = suites.select("module", F.lit(None).cast("boolean").alias("passed"), yes.alias("asked"))
    both = results.select("module", "passed", no.alias("asked")).unionByName(asked)
    counted = both.groupBy("module").agg(*counts, F.bool_or("asked").alias("asked"), F.bool_or(~F.col("asked")).alias("ran"))
    shown = [F.when(F.col("ran"), F.col(c)).alias(c) for c in ("passed", "failed")]
    return counted.where("asked").select("module", *shown, F.when(F.col("ran"), status).otherwise(F.lit("ERROR")).alias("status"))


def total_rollup(suites: DataFrame) -> DataFrame:
    """Sums over all suites; an ERROR suite adds nothing but denies approval."""
    return suites.agg(
        F.count(F.lit(1)).alias("suites"),
        F.coalesce(F.sum(F.coalesce("passed", F.lit(0))), F.lit(0)).alias("passed"),
        F.coalesce(F.sum(F.coalesce("failed", F.lit(0))), F.lit(0)).alias("failed"),
        F.coalesce(F.bool_and(F.col("status") == "PASSED"), F.lit(False)).alias("all_pass"),
    )


def suites_and_total(results: DataFrame, suites: DataFrame | None = None) -> DataFrame:
    """Per-module rows and the grand total (``is_total``), rolled up from one row per module.

    ``suites`` as in ``suite_rollup``: one without a result is an ERROR and the total FAILED.
    """
    total = F.grouping("module") == 1
    status = (
        F.when(~total & F.bool_or(F.col("status") == "ERROR"), F.lit("ERROR"))
        .when(F.bool_and(F.col("status") == "PASSED"), F.lit("PASSED"))
        .otherwise(F.lit("FAILED"))
    )
    return (
        suite_rollup(results, suites)
        .rollup("module")
        .agg(F.sum("passed").alias("passed"), F.sum("failed").alias("failed"), total.alias("is_total"), status.alias("status"))
    )


def review(suites: DataFrame, issues: DataFrame) -> DataFrame:
    """Approval of a run: every suite passed and nothing was found (``inventory.validation_issues``).

    Findings stay rows of their own table; here they are counted per type.
    """
    failing = (F.col("status") != "PASSED").alias("failing")
    rows = suites.select(failing, F.lit(None).cast("string").alias("issue_type")).unionByName(
        issues.select(F.lit(False).alias("failing"), "issue_type")
    )

    def of(kind: str) -> Column:
        return F.count_if(F.col("issue_type") == kind)

    counted = rows.agg(
        F.count_if("failing").alias("failing_suites"),
        of("Missing Coverage").alias("missing_coverage"),
        of("Hallucination").alias("hallucinations"),
        of("Syntax Error").alias("syntax_errors"),
        F.count("issue_type").alias("__issues"),
    )
    advice = (
        F.when(F.col("failing_suites") > 0, F.lit("Fix the failing cases."))
        .when(F.col("hallucinations") > 0, F.lit("Drop cases of functions that do not exist."))
        .when(F.col("syntax_errors") > 0, F.lit("Repair the sources that do not parse."))
        .when(F.col("missing_coverage") > 0, F.lit("Capture the functions no case covers."))
    )
    approved = (F.col("failing_suites") == 0) & (F.col("__issues") == 0)
    return counted.select(
        approved.alias("is_approved"),
        "failing_suites",
        "missing_coverage",
        "hallucinations",
        "syntax_errors",
        advice.alias("recommendation"),
    )


# Arguments that count as edge cases, by identity key.
_EDGE_KEYS = ("null", "nan", "0", "-1", '""', "[]", "{}")


def function_profile(captures: DataFrame, k: int = 5) -> DataFrame:
    """Per function: counts, output range, and up to ``k`` mappings, crashes and edge cases in capture order."""
    ok = F.col("status").eqNullSafe(SUCCESS)
    edge = F.exists("arg_keys", lambda a: a.isin(*_EDGE_KEYS))
    bucket = F.when(~ok, F.lit("crash")).when(edge, F.lit("edge")).otherwise(F.lit("mapping"))
    shown = F.struct(
        "seq",
        F.array_join("arg_json", ", ").alias("arguments"),
        F.coalesce("out_json", "out_digest", "error").alias("outcome"),
    )
    counts = captures.groupBy("module", "function").agg(
        F.count_if(ok).alias("successes"),
        F.count_if(~ok).alias("crashes"),
        F.count_if(edge).alias("edge_calls"),
        F.min("out_double").alias("min_output"),
        F.max("out_double").alias("max_output"),
        F.approx_count_distinct("out_key").alias("distinct_outputs"),
    )
    picked = top_k(
        captures.select("module", "function", "seq", bucket.alias("bucket"), shown.alias("shown")),
        ["module", "function", "bucket"],
        ["seq"],
        k,
    )

    def examples(name: str):
        # At most k structs per bucket reach this list.
        return F.array_sort(F.collect_list(F.when(F.col("bucket") == name, F.col("shown"))))

    lists = picked.groupBy("module", "function").agg(
        examples("mapping").alias("successful_mappings"),
        examples("crash").alias("crash_examples"),
        examples("edge").alias("edge_cases"),
    )
    return counts.join(lists, ["module", "function"])
