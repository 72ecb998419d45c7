"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handed to Python at once, and bytes after which no more are added. Rows may be long texts: a worker holds so many
#: bytes and one text at most.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20

ARROW_TYPES = {
    "string": pa.string(),
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Lower the session's Arrow batches to ``rows`` and ``size`` bytes unless they are lower already.

    Spark reads these settings when a query runs, which is after the operator
    has returned, so they stay lowered.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        found = spark.conf.get(key).lower().removesuffix("b")
        now = int(found) if found.lstrip("-").isdigit() else 0  # a size with a unit is none of ours
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def hand_back() -> None:
    """Give memory that is free in this worker back to the machine; workers live on between tasks."""
    with contextlib.suppress(Exception):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def annotate(
    df: DataFrame,
    inputs: Sequence[str],
    fields: str,
    make: Callable[[], Callable[..., Sequence[Sequence[Any]]]],
    keep: Sequence[str],
) -> DataFrame:
    """Run a batch function over ``df`` and return ``keep`` plus the columns it computes.

    ``make()`` is called once per task and returns a function of the input
    columns (as Python lists) giving one list per field of the DDL ``fields``.
    Only ``inputs`` and ``keep`` are read, so other columns, whatever their
    names, are pruned from the scan. A kept column named like a computed one
    gives way to the computed one.
    """
    small_batches(df.sparkSession)
    added = T.StructType.fromDDL(fields)
    keep = [c for c in dict.fromkeys(keep) if c not in added.names]
    used = list(dict.fromkeys([*keep, *inputs]))
    narrow = df.select(*[F.col(f"`{c}`") for c in used])
    schema = T.StructType([narrow.schema[c] for c in keep] + added.fields)
    kinds = [ARROW_TYPES[f.dataType.simpleString()] for f in added.fields]
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(used.index(c)).to_pylist() for c in inputs]
            out = fn(*columns)
            arrays = [b.column(used.index(c)) for c in keep]
            arrays += [pa.array(v, type=k) for v, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        hand_back()

    return narrow.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
