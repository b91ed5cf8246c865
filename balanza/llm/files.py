"""Files that tasks write and read in the shared folder, by pyarrow's file systems (file, hdfs, s3, gs).

A task names its files after its attempt and returns their names as rows. Readers open only the files of
the rows that Spark committed, so a repeated or lost attempt leaves at most an unused file.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from balanza.session import checkpoint_root


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared folder; it comes into being with its first file."""
    return f"{checkpoint_root(spark)}/files/{name}-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    return fs, path


def read_bytes(uri: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def attempt() -> tuple[int, int]:
    """(partition, attempt) of the running task."""
    ctx = TaskContext.get()
    return ctx.partitionId(), ctx.taskAttemptId()


def one_task_each(rows: DataFrame) -> DataFrame:
    """A row names a file's worth of work; each gets a task, up to 10,000 tasks."""
    return rows.repartition(max(1, min(rows.count(), 10_000)))
