"""Function inventory: which functions a table of source texts defines, and which of them were captured."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("seq", T.IntegerType()),
            T.StructField("name", T.StringType()),
            T.StructField("args", T.ArrayType(T.StringType())),
            T.StructField("testable", T.BooleanType()),
        ]
    )
)

# Reasons in the inventory.
TESTABLE, SKIPPED = "ok", "uses input()"


def top_level_functions(source: str | None) -> list[tuple] | None:
    """(place, name, plain positional arguments, asks for no input) per top-level ``def``; None if it does not parse."""
    if source is None:
        return None
    try:
        body = ast.parse(source).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None

    def asks(node: ast.AST) -> bool:
        calls = (n.func for n in ast.walk(node) if isinstance(n, ast.Call))
        return any(isinstance(f, ast.Name) and f.id == "input" for f in calls)

    defs = [node for node in body if isinstance(node, ast.FunctionDef)]
    return [(i, d.name, [a.arg for a in d.args.args], not asks(d)) for i, d in enumerate(defs)]


def _parsed(sources: DataFrame) -> DataFrame:
    # As a deterministic function the optimizer would also evaluate it in a filter it infers for explode, parsing twice.
    parse = F.udf(top_level_functions, _FOUND, useArrow=True).asNondeterministic()
    return sources.withColumn("__found", parse("source"))


def function_inventory(sources: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per top-level function of each source; sources that do not parse give none."""
    found = _parsed(sources).select("path", "module", *keep, F.explode("__found").alias("f"))
    return found.select(
        "path",
        "module",
        *keep,
        F.col("f.seq").alias("seq"),
        F.col("f.name").alias("function"),
        F.col("f.args").alias("args"),
        F.col("f.testable").alias("testable"),
        F.when(F.col("f.testable"), F.lit(TESTABLE)).otherwise(F.lit(SKIPPED)).alias("reason"),
    )


def syntax_errors(sources: DataFrame) -> DataFrame:
    """Sources that do not parse."""
    return _parsed(sources).where(F.col("__found").isNull()).select("path", "module")


def inventory_summary(inventory: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Testable and skipped functions per file; with ``sources`` also the files that define none."""
    counted = inventory.groupBy("path").agg(
        F.count_if("testable").alias("testable"), F.count_if(~F.col("testable")).alias("skipped")
    )
    if sources is None:
        return counted
    return sources.select("path").distinct().join(counted, "path", "left").fillna(0, ["testable", "skipped"])


def coverage_gap(inventory: DataFrame, captures: DataFrame) -> DataFrame:
    """Testable functions without a capture (``uncaptured``), captured ones without a definition (``undefined``).

    Both sides are tagged and reduced to one row per function in a single exchange, so sources are parsed once and a
    function with most of the captures costs one row per task.
    """
    no, yes = F.lit(False), F.lit(True)
    names = ["module", "function"]
    defined = inventory.select(*names, yes.alias("defined"), "testable", no.alias("captured"))
    seen = captures.select(*names, no.alias("defined"), no.alias("testable"), yes.alias("captured"))
    known = defined.unionByName(seen).groupBy(*names).agg(
        F.bool_or("defined").alias("defined"),
        F.bool_or("testable").alias("testable"),
        F.bool_or("captured").alias("captured"),
    )
    gap = F.when(F.col("testable") & ~F.col("captured"), F.lit("uncaptured")).when(
        F.col("captured") & ~F.col("defined"), F.lit("undefined")
    )
    return known.select(*names, gap.alias("gap")).where("gap IS NOT NULL")


def validation_issues(gaps: DataFrame, broken_sources: DataFrame | None = None) -> DataFrame:
    """Review findings as rows: cases for functions that do not exist, functions no case covers, unreadable sources."""
    missing = F.col("gap") == "uncaptured"
    issues = gaps.select(
        "module",
        F.concat(F.lit("test_"), "function").alias("test_name"),
        F.when(missing, F.lit("Missing Coverage")).otherwise(F.lit("Hallucination")).alias("issue_type"),
        F.when(missing, F.concat(F.lit("No case covers "), "function", F.lit(".")))
        .otherwise(F.concat(F.lit("Function "), "function", F.lit(" not found.")))
        .alias("description"),
    )
    if broken_sources is None:
        return issues
    return issues.unionByName(
        broken_sources.select(
            "module",
            F.concat(F.lit("test_"), "module").alias("test_name"),
            F.lit("Syntax Error").alias("issue_type"),
            F.concat(F.lit("Source "), "path", F.lit(" does not parse.")).alias("description"),
        )
    )
