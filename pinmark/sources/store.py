"""The capture store and the suites: parquet, one partition per module."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CAPTURES, CASE_KEY, EXPECTATIONS

# Characters Spark escapes in partition folder names.
_ESCAPED = set('"#%\'*/:=?\\{[]^') | {chr(c) for c in range(1, 32)} | {chr(127)}


def scan_store(spark: SparkSession, path: str, schema: T.StructType, module: str | None = None) -> DataFrame:
    """All rows, or those of one module by partition pruning; a store that is not there yet is empty."""
    ordered = [f for f in schema.fields if f.name != "module"] + [schema["module"]]
    try:
        rows = spark.read.schema(T.StructType(ordered)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    rows = rows.select(*schema.fieldNames())
    return rows if module is None else rows.where(F.col("module") == module)


def scan_captures(spark: SparkSession, path: str, module: str | None = None) -> DataFrame:
    return scan_store(spark, path, CAPTURES, module)


def scan_expectations(spark: SparkSession, path: str, module: str | None = None) -> DataFrame:
    return scan_store(spark, path, EXPECTATIONS, module)


def scan_suites(expectations: DataFrame) -> DataFrame:
    """Names of the suites at hand, sorted."""
    names = expectations.select("module").distinct()
    return names.select("module", F.concat(F.lit("test_"), "module", F.lit(".py")).alias("suite")).orderBy("suite")


def write_modules(new: DataFrame, path: str, modules: Sequence[str]) -> None:
    """Replace the rows of ``modules`` by those in ``new``; other modules stay untouched.

    Spark overwrites just the partitions that have new rows. A listed module that has none any more is emptied on its
    own. REBALANCE splits a module that holds most rows over several files and joins small ones.
    """
    if not modules:
        return
    named = new.where(F.col("module").isin(*modules))
    # Seen while the rows are written, so they are not computed a second time; no more names than were listed.
    found = Observation()
    (
        named.observe(found, F.collect_set("module").alias("modules"))
        .hint("rebalance", "module")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("module")
        .parquet(path)
    )
    columns = T.StructType([f for f in new.schema.fields if f.name != "module"])
    none = new.sparkSession.createDataFrame([], columns).coalesce(1)
    written = set(found.get["modules"])
    for module in modules:
        if module not in written:
            none.write.mode("overwrite").parquet(f"{path}/module={_escaped(module)}")


def write_bucketed(df: DataFrame, table: str, buckets: int, keys: Sequence[str] = CASE_KEY, **options: str) -> None:
    """Keep expectations that are verified again and again as a table bucketed by their case key.

    A later ``verify`` on these keys exchanges the fresh captures only. If those are all of one function that is given
    as a constant, Spark joins on ``seq`` alone and the table should be bucketed by it.
    """
    writer = df.write.mode("overwrite").options(**options)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def _escaped(name: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in name)


def reset_store(empty: DataFrame, path: str) -> None:
    """Start a full run with an empty store, also where the session replaces only the partitions that are written."""
    empty.limit(0).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("module").parquet(path)


def replaced(store: DataFrame, new: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """What the store holds after its modules in ``modules`` (those of ``new`` by default) were replaced."""
    names = (new if modules is None else modules).select("module").distinct()
    return store.join(names, "module", "left_anti").unionByName(new)
