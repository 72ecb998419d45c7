"""Header operators: program chains, replacing headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def program_depths(programs: DataFrame, most: int = 64) -> DataFrame:
    """``programs`` (id, pp) with ``depth``, the steps to the chain's root; an error for a chain that runs in a circle.

    Pointers are doubled each round, so chains of length n take log2(n) joins.
    """
    jumps = programs.select("id", "pp", F.col("pp").alias("up"), F.when(F.col("pp").isNull(), 0).otherwise(1).cast("bigint").alias("depth"))
    for _ in range(max(1, most.bit_length())):
        above = jumps.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        jumps = jumps.join(above, "up", "left").select(
            "id", "pp", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
        )
    settled = F.when(F.col("up").isNull(), F.col("depth")).otherwise(F.raise_error(F.lit("program chain in a circle or too long")).cast("bigint"))
    return jumps.select("id", "pp", settled.alias("depth"))


def reheader(lines: DataFrame, header: DataFrame, comment: str) -> DataFrame:
    """(part, value): a new header's lines (part 0), then the records as they were (part 1)."""
    body = lines.where(~F.col("value").startswith(comment)).select(F.lit(1).alias("part"), "value")
    return header.select(F.lit(0).alias("part"), "value").unionByName(body)
