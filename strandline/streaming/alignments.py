"""Statistics over alignment records as they arrive, by Structured Streaming.

The aggregates are the batch operators themselves: their state is one row a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment as ops
from ..sources import text


def sam_stream(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """Alignment records of the SAM files that come into a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)
    return text.sam_fields(lines)


def flagstat_stream(alignments: DataFrame) -> DataFrame:
    """Running flag statistics; write in complete or update mode. Needs mate_ref_id and ref_id, or their names."""
    if "ref_id" not in alignments.columns:
        alignments = alignments.withColumnsRenamed({"ref_name": "ref_id", "mate_ref_name": "mate_ref_id"})
    return ops.flagstat(alignments)


def arrivals(events: DataFrame, time: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Records per reference and window of arrival; a window is final once ``late`` has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "ref_name").agg(F.count("*").alias("n"))
