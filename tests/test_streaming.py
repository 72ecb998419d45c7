"""Aggregates over files as they arrive equal those over all files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strandline.operators import alignment as ops
from strandline.plans.formats import SAM_HEADER
from strandline.sources import text
from strandline.streaming.alignments import arrivals, flagstat_stream, sam_stream


def line(i):
    flags = [0, 4, 16, 512, 1024, 99, 147, 256][i % 8]
    return f"r{i}\t{flags}\tsq{i % 3}\t{1 + i}\t60\t4M\t=\t{1 + i}\t0\tACGT\tIIII"


def test_running_flag_statistics(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(5):
        (folder / f"{k}.sam").write_text("\n".join([*SAM_HEADER, *(line(i) for i in range(40 * k, 40 * k + 40))]) + "\n")
    stream = flagstat_stream(sam_stream(spark, f"file://{folder}", 2))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("stats").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert len(query.recentProgress) >= 3
    whole = text.sam_fields(text.lines(spark, f"file://{folder}")).withColumnsRenamed({"ref_name": "ref_id", "mate_ref_name": "mate_ref_id"})
    key = lambda r: str(r)
    assert sorted(map(tuple, spark.table("stats").collect()), key=key) == sorted(map(tuple, ops.flagstat(whole).collect()), key=key)


def test_windows_close_when_their_time_has_passed(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [[(base + dt.timedelta(minutes=m), "sq0") for m in (1, 2, 15)], [(base + dt.timedelta(hours=3), "sq1")], [(base + dt.timedelta(hours=3, minutes=11), "sq1")], [(base + dt.timedelta(minutes=3), "sq0"), (base + dt.timedelta(hours=3, minutes=1), "sq1")], [(base + dt.timedelta(hours=9), "sq1")]]
    folder = f"file://{tmp_path}/in"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "at timestamp, ref_name string").coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    stream = spark.readStream.schema("at timestamp, ref_name string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(folder)
    counted = arrivals(stream, "at", "10 minutes", "1 hour").select(F.col("window.start").alias("start"), "ref_name", "n")
    query = counted.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["start"], r["ref_name"]): r["n"] for r in spark.table("windows").collect()}
    # the record of minute 3 came two batches after its window had closed
    assert got[base, "sq0"] == 2 and got[base + dt.timedelta(minutes=10), "sq0"] == 1 and got[base + dt.timedelta(hours=3), "sq1"] == 2
