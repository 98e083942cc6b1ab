"""Capture records and test outcomes out of noisy log text.

Logs are tables of lines ``(module, line_no, line)``, so one huge log spreads over tasks like any other rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encode
from ..functions.text import python_strip
from ..operators.capture import _arrays
from ..operators.ordering import top_k
from ..schema import CAPTURE_COLUMNS, CAPTURES, CRASHED, SUCCESS

# Outcome marks of a verbose test run (the leading blank is part of them) and the openings of run texts.
PASSED_MARK, FAILED_MARK, ERROR_MARK = " PASSED", " FAILED", " ERROR"
RUN_SUCCESS = "Execution Successful"
RUN_FAILED = "Execution Failed with Exit Code"
RUN_FAULT = "Sandbox Fault"
RUN_SYSTEM = "System Error"
TAIL_PASSED, TAIL_FAILED, HEAD_ERROR, HEAD_PREVIEW = 300, 500, 200, 500

_STRICT_JSON = {"allowSingleQuotes": "false"}


def log_lines(logs: DataFrame, text: str = "log", module: str = "module") -> DataFrame:
    """One row per line of each log text."""
    return logs.select(
        F.col(module).alias("module"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


def _braced(lines: DataFrame) -> DataFrame:
    bare = lines.withColumn("line", python_strip(F.col("line")))
    return bare.where(F.startswith("line", F.lit("{")) & F.endswith("line", F.lit("}")))


def _decoded(lines: DataFrame) -> DataFrame:
    """Lines that look like a record, with ``__record``, NULL if it does not decode."""
    # As the only element of an array the line must be one whole JSON value: two records on a line do not parse.
    listed = F.from_json(F.concat(F.lit("["), F.col("line"), F.lit("]")), "array<variant>", _STRICT_JSON)
    decoded = _braced(lines).withColumn("__items", listed)
    # A filter on a projected value would be pushed below it and decode every line twice; one on a generated row stays.
    single = F.when(F.size("__items") == 1, F.col("__items"))
    return decoded.select("module", "line_no", "line", F.explode_outer(single).alias("__record"))


def parse_capture_log(lines: DataFrame) -> DataFrame:
    """Records of lines that are a JSON object, decoded in the JVM; other and undecodable lines drop out.

    ``args`` and ``output`` stay VARIANT. An object that names a key twice counts as undecodable. For canonical
    captures with equality keys see ``captures_from_log``.
    """
    record = F.col("__record")

    def text(field: str) -> Column:
        return F.try_variant_get(record, f"$.{field}", "string").alias(field)

    parsed = _decoded(lines).where(record.isNotNull())
    return parsed.select(
        "module",
        "line_no",
        text("function"),
        text("status"),
        text("error"),
        text("traceback"),
        F.try_variant_get(record, "$.inputs.args", "array<variant>").alias("args"),
        F.try_variant_get(record, "$.output", "variant").alias("output"),
    )


def corrupt_lines(lines: DataFrame) -> DataFrame:
    """Lines that look like a record and do not decode."""
    return _decoded(lines).where(F.col("__record").isNull()).select("module", "line_no", "line")


def silent_logs(runs: DataFrame, log: str = "log") -> DataFrame:
    """Runs whose log holds no capture record, with the start of what they said instead. A narrow step."""

    def is_record(line: Column) -> Column:
        bare = python_strip(line)
        braced = F.startswith(bare, F.lit("{")) & F.endswith(bare, F.lit("}"))
        listed = F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<variant>", _STRICT_JSON)
        return F.coalesce(F.when(braced, F.size(listed) == 1), F.lit(False))

    # A run without a log has not spoken either.
    spoken = F.coalesce(F.exists(F.split(F.col(log), "\n"), is_record), F.lit(False))
    return runs.where(~spoken).withColumn("preview", F.left(F.col(log), F.lit(HEAD_PREVIEW))).drop(log)


def captures_from_log(lines: DataFrame, digest_limit: int = encode.DIGEST_LIMIT) -> DataFrame:
    """Canonical captures of foreign log lines.

    Keys of arbitrarily nested values need recursion, so lines that passed the JVM filter are decoded in Arrow batches.
    An object that names a key twice is undecodable, as in ``parse_capture_log``. Fields that should be texts and are
    not are taken as their JSON text. An error that Python knows by its name also matches the bases of its class.
    """

    def once(pairs: list[tuple]) -> dict:
        found = dict(pairs)
        if len(found) < len(pairs):
            raise ValueError("a key is named twice")
        return found

    def text(value) -> str | None:
        return value if value is None or isinstance(value, str) else json.dumps(value)

    def record(module, line_no, line) -> tuple | None:
        try:
            found = json.loads(line, object_pairs_hook=once)
        except (ValueError, RecursionError):
            return None
        inputs = found.get("inputs")
        args = inputs.get("args") if isinstance(inputs, dict) else None
        call = (module, text(found.get("function")), line_no, *encode.arguments(args if isinstance(args, list) else []))
        if found.get("status") == SUCCESS:
            return (*call, SUCCESS, *encode.output(found.get("output"), digest_limit), None, None, None, None)
        error = text(found.get("error"))
        name = (error.split(":")[0] if ": " in error else error).strip(" ") if error else "Exception"
        return (*call, CRASHED, *[None] * 7, error, name, encode.class_names(name), text(found.get("traceback")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [record(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays(
                _arrays([r for r in rows if r is not None], CAPTURES.fields), names=CAPTURE_COLUMNS
            )

    return _braced(lines).select("module", F.col("line_no").cast("bigint"), "line").mapInArrow(run, CAPTURES)


def occurrences(text: Column, mark: str) -> Column:
    """Non-overlapping occurrences of a fixed text."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    return (removed / len(mark)).cast("bigint")


def count_outcomes(text: Column) -> list[Column]:
    return [
        occurrences(text, PASSED_MARK).alias("passed"),
        occurrences(text, FAILED_MARK).alias("failed"),
        occurrences(text, ERROR_MARK).alias("errors"),
    ]


def log_suites(lines: DataFrame) -> DataFrame:
    """Outcome per module from the lines of its test-run log; failures and errors add up."""
    counted = lines.select("module", *count_outcomes(F.col("line"))).groupBy("module")
    sums = counted.agg(F.sum("passed").alias("passed"), F.sum(F.col("failed") + F.col("errors")).alias("failed"))
    return sums.withColumn("status", F.when(F.col("failed") == 0, F.lit("PASSED")).otherwise(F.lit("FAILED")))


def suite_results(runs: DataFrame, log: str = "log", fault: str = "fault") -> DataFrame:
    """One row per run: status, counts and a bounded piece of its log.

    A run without a log is an ERROR with the start of its fault text and no counts.
    """
    text = F.col(log)
    counted = runs.select("*", *count_outcomes(text))
    bad = F.col("failed") + F.col("errors")
    ran = text.isNotNull()
    clean = bad == 0
    return counted.withColumns(
        {
            "status": F.when(~ran, F.lit("ERROR")).when(clean, F.lit("PASSED")).otherwise(F.lit("FAILED")),
            "failed": F.when(ran, bad),
            "detail": F.when(~ran, F.left(F.col(fault), F.lit(HEAD_ERROR)))
            .when(clean, tail(text, TAIL_PASSED))
            .otherwise(tail(text, TAIL_FAILED)),
        }
    ).drop("errors", log, fault)


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def head(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def log_tail(lines: DataFrame, n: int) -> DataFrame:
    """Last ``n`` characters of each module's log.

    A line break counts as a character, so the last ``n`` lines hold them all; each is cut to ``n`` before it moves.
    """
    last = top_k(
        lines.select("module", "line_no", F.right("line", F.lit(n)).alias("line")),
        ["module"],
        [F.col("line_no").desc()],
        n,
    )
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n"
    )
    return last.groupBy("module").agg(tail(joined, n).alias("detail"))


def run_outcome(text: Column) -> list[Column]:
    """Kind of a run text, its exit code and what follows the opening."""
    kind = (
        F.when(F.startswith(text, F.lit(RUN_SUCCESS)), F.lit("success"))
        .when(F.startswith(text, F.lit(RUN_FAILED)), F.lit("failed"))
        .when(F.startswith(text, F.lit(RUN_FAULT)), F.lit("fault"))
        .when(F.startswith(text, F.lit(RUN_SYSTEM)), F.lit("system_error"))
        .otherwise(F.lit("unknown"))
    )
    code = F.regexp_extract(text, r"^" + RUN_FAILED + r" (-?\d+)", 1)
    after_logs = F.regexp_replace(text, r"^[^\n]*?\.(\nError Logs:| Output Logs:)\n", "")
    after_colon = F.regexp_replace(text, r"^(Sandbox Fault|System Error): ", "")
    return [
        kind.alias("kind"),
        F.when(kind == "success", F.lit(0)).when(kind == "failed", code.try_cast("int")).alias("exit_code"),
        F.when(kind.isin("success", "failed"), after_logs)
        .when(kind.isin("fault", "system_error"), after_colon)
        .otherwise(text)
        .alias("body"),
    ]
