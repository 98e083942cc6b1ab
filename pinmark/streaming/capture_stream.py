"""Capture logs that arrive over time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordering import numbered
from ..operators.verify import beside, judge
from ..schema import CASE_KEY
from ..sources.files import module_name
from ..sources.logs import captures_from_log


def log_stream(
    spark: SparkSession, folder: str, module: Column | None = None, files_per_trigger: int = 1000
) -> DataFrame:
    """Lines of log files as they are added, with the file and the part of it they come from.

    ``module`` is taken from ``_metadata.file_path``; by default it is the file's name without its suffix.
    """
    lines = (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", True)
        .text(folder)
    )
    if module is None:
        name = module_name(F.url_decode(F.col("_metadata.file_path")))
        module = F.regexp_replace(name, r"\.(log|txt)$", "")
    return lines.select(
        module.alias("module"),
        F.lit(None).cast("bigint").alias("line_no"),
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write one micro-batch under its own number: a batch that is run again replaces itself."""
    (
        rows.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def lines_before(spark: SparkSession, counts: str, batch_id: int) -> int:
    """How many lines the batches before this one had."""
    try:
        told = spark.read.parquet(counts)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return told.where(F.col("batch_id") < batch_id).agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]


def numbered_lines(lines: DataFrame, batch_id: int, counts: str) -> DataFrame:
    """One micro-batch with ``line_no``, the position of each line in the whole stream.

    Lines go by batch, file, and place in the file. What must be known of earlier batches is how many lines they had: one
    number a batch, kept under its own number, so a batch that is run again finds and leaves the same. Within a batch
    lines are numbered from the sizes of tasks (``ordering.numbered``), so neither a file nor a module is in one task.
    """
    spark = lines.sparkSession
    rest = lines.drop("line_no").withColumn("at", F.monotonically_increasing_id())
    placed = numbered(rest, "line_no", ["file", "block", "at"])
    size = placed.agg(F.count(F.lit(1)).alias("lines"))
    write_batch(size, batch_id, counts)
    return placed.withColumn("line_no", F.col("line_no") + lines_before(spark, counts, batch_id))


def _each_batch(lines: DataFrame, checkpoint: str, available_now: bool, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    writer = lines.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def capture_stream(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    *,
    parse: Callable[[DataFrame], DataFrame] = captures_from_log,
    number: bool = False,
    available_now: bool = True,
) -> StreamingQuery:
    """Parse a stream of log lines (``log_stream``) into the store at ``path``.

    Parsing keeps no state, so there is nothing to watermark; repeats of batches do not matter. With ``number`` records
    get ``seq``, the position of their line in the stream, and so are cases that can be pinned and verified; their counts
    are kept beside the checkpoint.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        told = numbered_lines(batch, batch_id, f"{checkpoint}-lines") if number else batch
        write_batch(parse(told), batch_id, path)

    return _each_batch(lines, checkpoint, available_now, work)


def verify_stream(
    lines: DataFrame,
    expectations: DataFrame,
    path: str,
    checkpoint: str,
    *,
    keys: Sequence[str] = CASE_KEY,
    parse: Callable[[DataFrame], DataFrame] = captures_from_log,
    exact: bool = False,
    available_now: bool = True,
) -> StreamingQuery:
    """Judge the cases of stored expectations as the lines of a fresh run arrive; results go to ``path`` by batch.

    A batch judges the cases it holds a capture of: only its captures are exchanged if the expectations are bucketed by
    ``keys``. Cases without a result have not been seen yet. Lines are numbered as in ``capture_stream``.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        fresh = parse(numbered_lines(batch, batch_id, f"{checkpoint}-lines"))
        seen = beside(expectations, fresh, keys).where(F.col("act_status").isNotNull())
        write_batch(judge(seen, exact=exact), batch_id, path)

    return _each_batch(lines, checkpoint, available_now, work)
