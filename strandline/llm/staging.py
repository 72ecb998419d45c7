"""Intermediate tables in the folder that driver and executors share.

Writing a result and reading it again cuts its lineage: a lost executor costs
the tasks it ran, not what led to the table.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import remove, shared_folder

#: Sides of joins with at most so many rows are broadcast; they have a few short columns.
BROADCAST_ROWS = 1_000_000

#: Rows that a task writes of a table that is known to be small: each task makes a file.
FILE_ROWS = 4096


def tasks_for(most: int, each: int) -> int:
    return max(1, -(-most // each))


class Staging:
    """Tables under one folder of their own, removed when the program ends or :meth:`close` is called."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables, self.paths = 0, {}
        atexit.register(self.close)

    def save(self, df: DataFrame, most: int | None = None, each: int = FILE_ROWS) -> DataFrame:
        """``df`` as a table. With ``most``, the rows or bytes it has at most, it takes no more tasks than have ``each`` of them.

        Each file costs a file system some calls, and a local one some processes. ``most`` is for tables that are
        dealt evenly; it changes nothing where there are fewer tasks anyway.
        """
        if most is not None:
            df = df.coalesce(tasks_for(most, each))
        self.tables += 1
        path = f"{self.root}/{self.tables}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)  # with the frame itself, so that its id stays its own
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that :meth:`save` returned and that nothing is to be read from any more."""
        for t in tables:
            _, path = self.paths.pop(id(t), (None, None))
            if path:
                remove(self.spark, path)

    def close(self) -> None:
        remove(self.spark, self.root)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows it to have at most ``rows`` rows, else as it is."""
    return df.hint("broadcast") if df.limit(rows + 1).count() <= rows else df


#: Rows of one key that are more than one task should join.
HOT_ROWS = 20_000


def join_skewed(left: DataFrame, right: DataFrame, key: str, weight: str, hot: int = HOT_ROWS) -> DataFrame:
    """The inner join of ``left`` with ``right``, which has a row a key and the rows of ``left`` with it as ``weight``.

    Keys with more than ``hot`` rows, which are fewer than the rows of ``left``
    / ``hot``, are sent to every task if a count shows them to be few; their
    rows are not shuffled. ``left`` is read twice then, so it should be a table.
    """
    heavy = right.where(right[weight] > hot)
    n = heavy.limit(BROADCAST_ROWS + 1).count()
    if not 0 < n <= BROADCAST_ROWS:
        return left.join(right, key)
    heavy = heavy.hint("broadcast")
    rest = left.join(heavy.select(key), key, "left_anti").join(right.where(right[weight] <= hot), key)
    return left.join(heavy, key).unionByName(rest)
