"""Tables that cut lineage, in the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or of its Spark context; a temporary folder where neither is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.gettempdir() + "/pinmark-shared"


def stored(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows of a narrow table, written once as Parquet and read again: computed once, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/pinmark-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
