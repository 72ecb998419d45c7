"""Format queries over every row of their tables."""

from __future__ import annotations

from strandline.plans.genomic import QUERIES


def test_codecs_take_every_text(spark, tmp_path):
    rows = [(i, "line of text\n" * (i % 7)) for i in range(90, 130)] + [(5000, None), (None, "é漢字 😀"), (10**9, "word " * 20_000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["method"]: (r["n"], r["same"]) for r in QUERIES["cdc01_cdc06_block_codecs"](spark, f"file://{tmp_path}").collect()}
    assert got == {m: (len(rows), True) for m in ("rans0", "rans1", "gzip", "bzip2", "lzma")}
