"""Folders for files that queries write and read again, where driver and executors both see them."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

from ..sources.files import remove, shared_folder


#: Rows of a file, about, where a table is written to files: what a task holds and takes doesn't grow with the table.
FILE_ROWS = 250_000


#: Texts whose coding by plain Python is a task's work.
CODED_ROWS = 500


def file_count(spark: SparkSession, d: str, table: str, least: int, each: int | None = None) -> int:
    """Files or tasks for a table's rows: ``least`` of a small one, else one for every ``each`` (``FILE_ROWS``) rows."""
    return max(least, -(-spark.read.parquet(f"{d}/{table}.parquet").count() // (each or FILE_ROWS)))


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at the end."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path
