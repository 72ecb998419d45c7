"""Steps whose tasks must not grow with their tables: files by rows, joined files, records encoded and decoded a batch at a time."""

from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from strandline.plans import scratch
from strandline.plans.genomic import QUERIES
from strandline.sources import bam, bgzf, cram, files, sinks

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables aren't here")
TAGS = pa.map_(pa.string(), pa.string())
SCHEMA = pa.schema(
    [("name", pa.string()), ("flags", pa.int32()), ("ref_id", pa.int32()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("mate_ref_id", pa.int32())]
    + [("mate_pos", pa.int64()), ("tlen", pa.int32()), ("sequence", pa.string()), ("quality", pa.string()), ("tags", TAGS)]
)


def alignments(n: int = 600) -> list[dict]:
    r, out = random.Random(3), []
    for i in range(n):
        k = r.randrange(9)
        cigar = r.choice([f"{k}M", f"1S{k - 3}M4D2I", None] if k > 3 else [f"{k}M"] if k else ["*", "3D2N", None])
        out.append(
            {
                "name": r.choice([None, "", f"r{i}"]), "flags": r.randrange(4096), "ref_id": r.choice([None, 0, 4]), "pos": r.choice([None, 0, 1, 5_000_000, 400_000_000]), "mapq": r.choice([None, 0, 255]),
                "cigar": cigar, "mate_ref_id": r.choice([None, 2]), "mate_pos": r.choice([None, 3]), "tlen": r.choice([None, -5, 10**6]), "sequence": "".join(r.choice("ACGTNacgtRY=") for _ in range(k)) or r.choice([None, ""]),
                "quality": r.choice([None, "".join(chr(33 + r.randrange(60)) for _ in range(k))]), "tags": r.choice([[], [("NH", "i:3"), ("RG", "Z:é x=1")], [("XB", "B:c,1,-2"), ("XF", "f:1.5")]]),
            }
        )
    return out


def test_batches_are_encoded_as_their_records(monkeypatch):
    rows = alignments()
    want = b"".join(bam.encode({**r, "tags": dict(r["tags"])}) for r in rows)
    monkeypatch.setattr(bam, "encode", None)  # no step for each record
    batch = pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
    assert bam.encode_batch(batch) == want
    assert bam.encode_batch(batch.slice(100, 50)) in want


def test_odd_records_are_left_to_the_plain_way():
    long = {"name": "l", "flags": 4, "cigar": "1M1I" * 40_000, "sequence": "A" * 80_000, "tags": []}
    batch = pa.RecordBatch.from_pylist([long], schema=SCHEMA)
    assert bam.encode_batch(batch) == bam.encode({**long, "tags": {}})
    with pytest.raises(bam.BamError):
        bam.encode_batch(pa.RecordBatch.from_pylist([{"flags": 0, "cigar": "3M", "sequence": "AC"}], schema=SCHEMA))
    data = bam.encode({**long, "tags": {}})
    got = bam.other_columns(data, np.array([0]), np.array([len(data)]), bam.Header("", []), ["name", "cigar"])
    assert list(got["cigar"]) == [long["cigar"]]


def test_records_are_decoded_a_run_at_a_time(monkeypatch):
    data = bam.encode_batch(pa.RecordBatch.from_pylist(alignments(), schema=SCHEMA))
    starts, end = bam._chain(data, 0)
    starts, columns, header = np.array([*starts, end]), ["name", "cigar", "sequence", "quality", "tags"], bam.Header("", [])
    want = [bam.decode(data, int(a), int(b), header, columns) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    monkeypatch.setattr(bam, "decode", None)
    got = bam.other_columns(data, starts[:-1], starts[1:], header, columns)
    assert list(zip(*(got[c].to_pylist() for c in columns), strict=True)) == want


@needs_data
def test_more_rows_make_more_files(spark, monkeypatch):
    monkeypatch.setattr(scratch, "FILE_ROWS", 500)
    listed, write = [], sinks.write_parts
    monkeypatch.setattr(sinks, "write_parts", lambda *a: listed.append(write(*a)) or listed[-1])
    # what has no reference is a tenth of the rows, all of one place
    got = QUERIES["agg06_counts_in_index_files"](spark, DATA).collect()
    sizes = [n for paths in listed for p in paths for _, n in files.list_files(p)]
    assert len(sizes) == 12 and max(sizes) < 2 * min(sizes)
    assert sum(r["mapped"] + r["unmapped"] for r in got) == spark.read.parquet(f"{DATA}/lineitem.parquet").count()


def test_files_are_joined_from_pieces(spark, tmp_path):
    rows = spark.range(0, 30_000, 1, 7).selectExpr("lpad(cast(id as string), 9, '0') as line")
    paths = sinks.write_bgzf(rows, f"file://{tmp_path}/f", ["#h"], into=2)
    held = [bytes().join(data for _, _, data in bgzf.BlockReader(files.open_file(p))).decode().splitlines() for p in paths]
    assert [h[0] for h in held] == ["#h", "#h"] and [int(x) for h in held for x in h[1:]] == list(range(30_000))
    assert sorted(os.listdir(tmp_path / "f")) == sorted(p.rsplit("/", 1)[1] for p in paths)


def test_small_splits_of_large_files_are_enlarged():
    assert bgzf.split_size(50_000, 10_000_000) == 50_000
    assert bgzf.split_size(50_000, 3_000_000_000) == 3_000_000
    assert bgzf.split_size(50_000, 10**13) == 64 << 20 and bgzf.split_size(1 << 30, 10**13) == 1 << 30


def test_many_reads_inflate_a_block_once(tmp_path, monkeypatch):
    from strandline.sources import indexes

    data = b"".join(b"%09d\n" % i for i in range(40_000))
    (tmp_path / "f.gz").write_bytes(bgzf.compress(data))
    opened, inflated, inflate = files.open_file(f"file://{tmp_path}/f.gz"), [], bgzf.inflate
    monkeypatch.setattr(bgzf, "inflate", lambda *a: inflated.append(1) or inflate(*a))
    reads = bgzf.Reads(opened, indexes.offsets_of(opened))
    assert b"".join(reads.read(10 * i, 10) for i in range(40_000)) == data and reads.read(len(data) - 4, 10) == data[-4:] and reads.read(len(data), 10) == b""
    assert len(inflated) < 20


HEADER = bam.Header("@HD\tVN:1.6\n@RG\tID:AF\n@SQ\tSN:a\tLN:400\n@SQ\tSN:b\tLN:400\n", [("a", 400), ("b", 400)])


def mapped_reads(n: int, seed: int) -> list[dict]:
    r, out = random.Random(seed), []
    for i in range(n):
        ops = [(r.randrange(1, 9), r.choice("MIDNSHP=X")) for _ in range(r.randrange(1, 4))]
        k = sum(size for size, op in ops if op in "MIS=X")
        out.append(
            {
                "name": r.choice([None, f"n{i // 3}"]), "flags": r.choice([0, 4, 97, 145, 2064]), "ref_id": r.choice([0, 1]), "pos": r.choice([1, 5, 395, 500]), "mapq": r.choice([None, 3]),
                "cigar": "".join(f"{size}{op}" for size, op in ops), "mate_ref_id": r.choice([None, 0]), "mate_pos": r.choice([None, 5]), "tlen": r.choice([None, 0, -9]), "sequence": "".join(r.choice("ACGTNRa") for _ in range(k)),
                "quality": r.choice([None, "".join(chr(33 + r.randrange(50)) for _ in range(k))]), "tags": r.choice([[], [("NH", "i:3"), ("RG", "Z:AF")], [("RG", "Z:other"), ("NH", "i:300")]]),
            }
        )
    for a, b in zip(out[::5], out[1::5], strict=False):  # mates that tell of each other
        for x, y, flags in ((a, b, 97), (b, a, 145)):
            x.update(name=f"p{id(a)}", flags=flags, ref_id=0, pos=5, cigar="5M", sequence="ACGTA", quality=None, mate_ref_id=0, mate_pos=5, tlen=5 if flags == 97 else -5)
    return out


@pytest.mark.parametrize("bases", [None, {"a": "ACGTNacRGT" * 40, "b": "GATTACACCA" * 40}])
def test_cram_containers_are_written_and_read_by_columns(bases, monkeypatch):
    references = lambda: cram.References((), dict(bases)) if bases else None
    columns = [c for c in bam.SCHEMA if c not in (*bam.PLACES, "bin")]
    for seed in range(30):
        rows = mapped_reads(40, seed)
        batch = pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
        want = cram._Writer(HEADER, references(), seed % 2 == 0, "raw").container([{**x, "tags": dict(x["tags"])} for x in rows])
        with monkeypatch.context() as m:
            m.setattr(cram._Writer, "container", None)  # no step for each record
            data = cram._Writer(HEADER, references(), seed % 2 == 0, "raw").batch(batch)
        assert data == want
        _, at = cram.read_container_header(data)
        for compression, head, blocks, _, _ in cram.slices_of(data[at:]):
            for some in (columns, ["flags"], ["tlen"], ["cigar", "pos"]):
                given = compression, head, blocks, HEADER, references() or cram.References()
                got = cram.slice_columns(*given, ["AF"], set(some), True)
                plain = cram.read_slice(*given, set(some))
                assert list(zip(*(got[c].to_pylist() for c in some), strict=True)) == [cram.row(r, HEADER, ["AF"], some) for r in plain]
                assert got["_end"].tolist() == [r.end for r in plain]


def test_bit_codes_take_no_step_for_each_bit(monkeypatch):
    from strandline.sources import bits

    values = [k * k % 300 for k in range(500)]
    monkeypatch.setattr(bits.BitReader, "bit", None)
    for e in (bits.Beta(3, 16), bits.Gamma(1), bits.Subexponential(0, 3), bits.GolombRice(0, 4), bits.Huffman(sorted(set(values)), [9] * len(set(values)))):
        assert bits.decoded(e, bits.coded(e, values), len(values)) == values
    with pytest.raises(bits.CodecError):
        bits.decoded(bits.Beta(0, 16), b"\0", 1)


@needs_data
def test_bins_are_folded_on_rows_of_bins(spark):
    """Chunks are joined once with where their bins go: nothing of theirs passes the windows that fold bins."""
    plan = QUERIES["agg16_folded_bins"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    folding = next(i for i, x in enumerate(plan) if "Window" in x and " at#" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    below = next(x for x in plan[folding:] if "Aggregate" in x)
    assert "first#" in below and "last#" in below and depth(below) > depth(plan[folding])


@needs_data
def test_texts_are_coded_by_many_tasks(spark):
    for name in ("cdc02_cdc03_adaptive_codecs", "cdc01_cdc06_block_codecs"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("base", ["C", "N"])
def test_modified_positions_by_letters(spark, base):
    from pyspark.sql import functions as F

    from strandline.functions import records

    rows = [("",), ("CCGGACGNCGT",), ("C" * 9,), ("G",), ("é" + "CG" * 6,)]
    skips = [1, 0, 2]
    df = spark.createDataFrame(rows, "s string")
    both = df.select("s", *(records.modified_positions(F.col("s"), base, F.array(*map(F.lit, skips)), F.lit(turned)).alias(k) for k, turned in (("f", False), ("r", True)))).collect()
    for r in both:
        for k, letter, order in (("f", base, 1), ("r", {"C": "G", "N": "N"}[base], -1)):
            at = [i for i, c in enumerate(r["s"]) if letter in (c, "N")][::order]
            assert r[k] == [at[n] if n < len(at) else None for n in (1, 2, 5)]
