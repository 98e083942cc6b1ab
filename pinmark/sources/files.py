"""Source files as a table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A task reads files until it has that many, or that many bytes; a larger file is a task of its own.
TASK_FILES = 1000
TASK_BYTES = 64 << 20


def module_name(path: Column) -> Column:
    """File name without any ``.py`` in it."""
    return F.replace(F.element_at(F.split(path, "/"), -1), F.lit(".py"), F.lit(""))


def without_generated(sources: DataFrame) -> DataFrame:
    """Drop cached and package files from a table with a ``path``."""
    name = F.element_at(F.split("path", "/"), -1)
    return sources.where(~F.contains("path", F.lit("__pycache__")) & (name != "__init__.py"))


def as_sources(table: DataFrame) -> DataFrame:
    """``(path, module, source)`` from any table that has ``path`` and ``source``."""
    return without_generated(table).select("path", module_name(F.col("path")).alias("module"), "source")


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system that holds ``root``, and the path in it. Without a scheme, or with ``file:``, it is the local one."""
    if "://" in root and not root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), unquote(urlparse(root).path) if root.startswith("file:") else root


@dataclass
class _Files(InputPartition):
    """Paths relative to the root."""

    paths: list[str]


class _SourceReader(DataSourceReader):
    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root.rstrip("/"), suffix

    def _listed(self) -> list[tuple[str, int]]:
        """(relative path, bytes) of all files with the suffix, sorted; names and folders that begin with a dot are left out."""
        system, base = file_system(self.root)
        found = []
        for info in system.get_file_info(fs.FileSelector(base, recursive=True)):
            path = info.path[len(base) :].lstrip("/")
            if info.type == fs.FileType.File and path.endswith(self.suffix) and not any(x.startswith(".") for x in path.split("/")):
                found.append((path, info.size or 0))
        return sorted(found)

    def partitions(self) -> list[_Files]:
        parts, size = [_Files([])], 0
        for path, n in self._listed():
            if parts[-1].paths and (len(parts[-1].paths) >= TASK_FILES or size + n > TASK_BYTES):
                parts.append(_Files([]))
                size = 0
            parts[-1].paths.append(path)
            size += n
        return parts

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, base = file_system(self.root)
        for path in partition.paths:
            with system.open_input_stream(f"{base}/{path}") as stream:
                text = stream.read().decode("utf-8", "replace")
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "source": pa.array([text])})


class SourceFiles(DataSource):
    """``spark.read.format("source_files")``: whole texts of the files under a folder, whatever their names.

    Unlike Spark's own file sources it keeps names that begin with an underscore and gives a row for an empty file. Options:
    ``path``, and ``suffix`` of the names (``.py``). Names and sizes are listed on the driver, as Spark lists files; the texts
    are read in tasks of at most ``TASK_FILES`` files or ``TASK_BYTES`` bytes, so a folder that holds most files is shared by
    tasks. A missing folder is an error, an empty one a table without rows. Bytes that are no UTF-8 are replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self) -> str:
        return "path string, source string"

    def reader(self, schema) -> DataSourceReader:
        return _SourceReader(self.options["path"], self.options.get("suffix", ".py"))


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """Python files under ``root`` with whole texts, by path relative to it, in the order of paths without a sort."""
    spark.dataSource.register(SourceFiles)
    return as_sources(spark.read.format("source_files").load(root))


def write_files(table: DataFrame, root: str) -> None:
    """Write ``source`` of each row to ``path`` under ``root``, a folder that all tasks see. A repeated task writes the same."""
    folder = root.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        for batch in batches:
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{base}/{path}") as stream:
                    stream.write((source or "").encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    table.select("path", "source").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
