"""Session settings and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "pinmark") -> SparkSession:
    """A session for tests and local measurements; on a cluster bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # Wide records are built of many expressions; recording a call site for each of them doubles the planning time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def pickle_by_value() -> None:
    """Let executors run this package's Arrow functions without having it installed."""
    import pinmark

    cloudpickle.register_pickle_by_value(pinmark)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local temporary one only where the session is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/pinmark-{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of a table, written once to the shared folder and read again: computed once, safe from lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a plain scan dealt out to all cores, if the scan has fewer splits than there are cores.

    A table of few row groups would otherwise be worked on by few tasks. A large table has more splits than the cluster
    has cores and is left alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tune(spark: SparkSession) -> SparkSession:
    """Runtime setting for the wide capture projections.

    The JVM does not compile methods above 8000 bytes of bytecode. With this limit Spark splits such a projection into
    smaller methods instead of fusing it into one that is interpreted.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark
