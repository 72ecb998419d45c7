"""Splits of binary variant files, and files that aren't blocked."""

from __future__ import annotations

import random

import pytest

from strandline.plans.formats import VCF_HEADER
from strandline.sources import bam, bcf, bgzf, detect


def variants(n, seed=1):
    r = random.Random(seed)
    strings, contigs = bcf.string_map(VCF_HEADER), bcf.contig_map(VCF_HEADER)
    rows = [{"chrom": f"chr{r.randrange(1, 23)}", "pos": i + 1, "ref": "ACGT"[: r.randrange(1, 4)] * r.choice([1, 1, 1, 400]), "alts": ["G"], "qual": 1.5, "filters": ["q10"], "info": {"DP": str(i)}, "gts": ["0|1"]} for i in range(n)]
    return bcf.header_bytes(VCF_HEADER) + b"".join(bcf.encode(x, strings, contigs, {"DP": "Integer"}) for x in rows)


@pytest.mark.parametrize("blocked", [True, False])
def test_variant_files_split_anywhere(spark, tmp_path, blocked, monkeypatch):
    monkeypatch.setattr(bcf, "PROOF", 1 << 13)
    data = variants(6000)
    payload = 5000  # small blocks, so that there are many
    raw = b"".join(bgzf.frame(data[k : k + payload]) for k in range(0, len(data), payload)) + bgzf.END_BLOCK if blocked else data
    (tmp_path / "x.bcf").write_bytes(raw)
    for split in (1, 700, 5000, 60_000, 1 << 24):
        if split < 5000 and not blocked:
            continue
        reader = bcf._BcfReader(f"file://{tmp_path}", None, split=max(split, len(raw) // 60))
        got = [row[1] for p in reader.partitions() for row, _ in bcf.records(p.path, p.chunks, p.begin, p.end)]
        assert got == list(range(1, 6001)), split
    rows = detect.read_variants(spark, f"file://{tmp_path}/x.bcf")
    assert rows.count() == 6000 and detect.variant_format(detect.head_of(f"file://{tmp_path}/x.bcf")) == ("bcf" if blocked else "raw bcf")


def test_files_that_are_not_blocked(spark, tmp_path):
    header = bam.Header("@HD\tVN:1.6\n", [("sq0", 100_000)])
    data = bam.header_bytes(header) + b"".join(bam.encode({"name": f"r{i}", "flags": 0, "ref_id": 0, "pos": i + 1, "sequence": "ACGT" * 30}) for i in range(20_000))
    (tmp_path / "x.bam").write_bytes(data)
    assert detect.alignment_format(detect.head_of(f"file://{tmp_path}/x.bam")) == "raw bam"
    rows = detect.read_alignments(spark, f"file://{tmp_path}/x.bam")
    assert rows.agg({"pos": "sum"}).first()[0] == sum(range(1, 20_001))
    for split in (100_000, 333_333):
        reader = bam._BamReader(f"file://{tmp_path}", ["pos"], split, None)
        assert [x for p in reader.partitions() for (x,) in reader._records(p)] == list(range(1, 20_001))
