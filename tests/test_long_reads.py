"""Splits of BAM files that begin inside a very long record."""

from __future__ import annotations

import random

from strandline.sources import bam, bgzf


def test_records_behind_a_long_one_are_read(tmp_path):
    r = random.Random(8)

    def row(k, n):
        return {"name": f"r{k}", "flags": 4, "tlen": 0, "sequence": "".join(r.choices("ACGT", k=n)), "quality": "".join(r.choices("!#+5?IJ", k=n)), "tags": {"XB": "B:i," + ",".join(str(r.randrange(300)) for _ in range(n // 50))} if n >= 50 else {}}

    header = bam.Header("@HD\tVN:1.6\n", [("sq0", 5000)])
    lengths = [100] * 400 + [500_000] + [100] * 400 + [300_000, 250_000] + [80] * 300
    rows = [row(k, n) for k, n in enumerate(lengths)]
    data = bam.header_bytes(header) + b"".join(bam.encode(x) for x in rows)
    path = tmp_path / "long.bam"
    blocks = [bgzf.frame(data[k : k + bgzf.PAYLOAD]) for k in range(0, len(data), bgzf.PAYLOAD)] + [bgzf.END_BLOCK]
    path.write_bytes(b"".join(blocks))
    want = [(x["name"], x["sequence"]) for x in rows]
    reader = bam._BamReader(f"file://{tmp_path}", ["name", "sequence"], 0, None)
    (whole,) = reader.partitions()
    at = 0
    for b in blocks[:-1]:
        at += len(b)
        parts = [bam.Split(whole.path, 0, at), bam.Split(whole.path, at, whole.end)]
        assert [x for p in parts for x in reader._records(p)] == want, at
    reader = bam._BamReader(f"file://{tmp_path}", ["name", "sequence"], 100_000, None)
    assert [x for p in reader.partitions() for x in reader._records(p)] == want
