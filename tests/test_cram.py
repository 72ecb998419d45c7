"""CRAM: encodings, containers, records against references, indexes."""

from __future__ import annotations

import random
import struct

import pytest

from strandline.sources import bam, bits, codecs, cram, detect, files


def test_bit_encodings_round_trip():
    r = random.Random(1)
    for make in (lambda: bits.Beta(5, 9), lambda: bits.Gamma(7), lambda: bits.Subexponential(3, 2), lambda: bits.Golomb(2, 5), lambda: bits.Golomb(2, 1), lambda: bits.GolombRice(4, 3)):
        e = make()
        values = [r.randrange(-2, 300) for _ in range(200)]
        back = bits.read_encoding(bits.Cursor(e.write()))
        assert type(back) is type(e) and bits.decoded(back, bits.coded(e, values), len(values)) == values
    h = bits.read_encoding(bits.Cursor(bits.Huffman([65, 66, 67, 300], [1, 3, 3, 2]).write()))
    values = [r.choice([65, 66, 67, 300]) for _ in range(100)]
    assert bits.decoded(h, bits.coded(h, values), 100) == values
    assert bits.decoded(bits.Huffman([7], [0]), b"", 3) == [7, 7, 7]
    # as stated: gamma of 5 is 00101, Golomb-Rice of 9 by 4 is 110 01, subexponential of 9 with k 2 is 110 001
    assert bits.coded(bits.Gamma(0), [5]) == bytes([0b00101000]) and bits.coded(bits.GolombRice(0, 2), [9]) == bytes([0b11001000]) and bits.coded(bits.Subexponential(0, 2), [9]) == bytes([0b11000100])


def test_integers():
    for v in (0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**35, 2**42 + 5, 2**49, 2**56 - 1, 2**56, 2**63 - 1, -1, -(2**63)):
        assert bits.Cursor(bits.ltf8(v)).ltf8() == v
    assert bits.ltf8(127) == b"\x7f" and bits.ltf8(128) == b"\x80\x80" and bits.ltf8(-1) == b"\xff" * 9
    assert bits.Cursor(bits.int_array([1, -1, 300])).ints() == [1, -1, 300]


def test_files_end_as_all_do():
    assert cram.end_container().hex() == "0f000000ffffffff0fe0454f4600000000010005bdd94f0001000606010001000100ee63014b"


def make_rows(seed, n=300, reference="ACGTNRACGGT" * 200):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        ref = r.choice([0, 0, 0, 1, None])
        pos = r.randrange(1, 2000) if ref is not None else None
        ops = [f"{r.randrange(1, 20)}{k}" for k in r.choice(["M", "SMIM", "MDM", "MNMS", "HSM", "MPIM", "M"])]
        cigar = "".join(ops)
        length = sum(int(x[:-1]) for x in ops if x[-1] in "MIS")
        seq, at, read = [], (pos or 1) - 1, 0
        for x in ops:
            k, m = x[-1], int(x[:-1])
            if k == "M":
                seq += [reference[at + j] if r.random() > 0.2 and at + j < len(reference) else r.choice("ACGTNRY") for j in range(m)]
            elif k in "IS":
                seq += [r.choice("ACGTN") for _ in range(m)]
            at += m if k in "MDN" else 0
            read += m
        flags = r.choice([0, 16, 1024, 256]) | (0 if ref is not None else 4)
        rows.append({
            "name": f"q{i}", "flags": flags, "ref_id": ref, "pos": pos, "mapq": None if flags & 4 else r.choice([None, 0, 60]), "cigar": None if flags & 4 else cigar, "mate_ref_id": r.choice([None, 1]),
            "mate_pos": r.choice([None, 77]), "tlen": r.choice([0, -5]), "sequence": "".join(seq) if i % 17 else None, "quality": "".join(chr(33 + r.randrange(60)) for _ in range(length)) if i % 5 and i % 17 else None,
            "tags": {"NH": "i:3", "RG": r.choice(["Z:g1", "Z:g2"])} if i % 3 else {"XA": "A:c", "XB": "B:s,1,-2", "XZ": "Z:text", "XF": "f:1.5"},
        })
    # a pair whose mate fields can be computed, and one whose can't
    pair = {"mapq": 9, "sequence": "ACGTA", "quality": "IIIII", "cigar": "5M", "tags": {}, "ref_id": 0, "mate_ref_id": 0}
    rows += [{**pair, "name": "p", "flags": 1 + 32 + 64, "pos": 10, "mate_pos": 40, "tlen": 35}, {**pair, "name": "p", "flags": 1 + 16 + 128, "pos": 40, "mate_pos": 10, "tlen": -35}]
    rows += [{**pair, "name": "o", "flags": 1 + 64, "pos": 10, "mate_pos": 40, "tlen": 99}, {**pair, "name": "o", "flags": 1 + 128, "pos": 40, "mate_pos": 10, "tlen": -99}]
    return rows


HEADER = bam.Header("@HD\tVN:1.6\n@SQ\tSN:sq0\tLN:2200\n@SQ\tSN:sq1\tLN:2200\n@RG\tID:g1\tSM:x\n@RG\tSM:y\tID:g2\n", [("sq0", 2200), ("sq1", 2200)])
FIELDS = "name string, flags int, ref_id int, pos bigint, mapq int, cigar string, mate_ref_id int, mate_pos bigint, tlen int, sequence string, quality string, tags map<string,string>"


def plain(r):
    return tuple(sorted(r[k].items()) if k == "tags" else r[k] for k in ("name", "flags", "ref_id", "pos", "mapq", "cigar", "mate_ref_id", "mate_pos", "tlen", "sequence", "quality", "tags"))


@pytest.fixture(scope="module")
def fasta(tmp_path_factory):
    path = tmp_path_factory.mktemp("fasta") / "r.fa"
    body = "ACGTNRACGGT" * 200
    path.write_text("".join(f">sq{i} x\n" + "".join(body[k : k + 60] + "\n" for k in range(0, len(body), 60)) for i in range(2)))
    offset = len(">sq0 x\n")
    second = offset + len(body) + -(-len(body) // 60) + len(">sq1 x\n")
    (tmp := path.parent / "r.fa.fai").write_text(f"sq0\t{len(body)}\t{offset}\t60\t61\nsq1\t{len(body)}\t{second}\t60\t61\n")
    assert tmp.exists()
    return f"file://{path}"


@pytest.mark.parametrize(("mode", "method"), [("none", "gzip"), ("reference", "gzip"), ("embedded", "gzip"), ("reference", "rans1"), ("none", "bzip2"), ("none", "lzma"), ("none", "nx16+193"), ("reference", "arith+1")])
def test_records_round_trip(spark, tmp_path, fasta, mode, method):
    rows = make_rows(3)
    df = spark.createDataFrame([tuple(r[k.split()[0]] for k in FIELDS.split(", ")) for r in rows], FIELDS).coalesce(1)
    folder = f"file://{tmp_path}/{mode}{method}"
    if mode == "embedded":  # slices of one reference only can hold theirs
        rows = [r for r in rows if r["ref_id"] == 0]
        df = df.where("ref_id = 0")
    cram.write_cram(df, folder, HEADER, [] if mode == "none" else [fasta], mode == "embedded", method, records=90)
    detect.register(spark)
    assert detect.alignment_format(detect.head_of(folder)) == "cram"
    got = detect.read_alignments(spark, folder, reference=[fasta] if mode == "reference" else []).collect()
    assert sorted((plain(r) for r in got), key=str) == sorted((plain(r) for r in rows), key=str)
    few = spark.read.format("cram").option("columns", "pos,mapq").load(folder)
    assert sorted(map(tuple, few.collect()), key=str) == sorted(((r["pos"], r["mapq"]) for r in rows), key=str)


def test_a_wrong_reference_is_refused(spark, tmp_path, fasta):
    rows = [r for r in make_rows(4) if r["ref_id"] == 0]
    df = spark.createDataFrame([tuple(r[k.split()[0]] for k in FIELDS.split(", ")) for r in rows], FIELDS).coalesce(1)
    cram.write_cram(df, f"file://{tmp_path}/x", HEADER, [fasta])
    detect.register(spark)
    (tmp_path / "other.fa").write_text(">sq0\n" + "A" * 2200 + "\n>sq1\nA\n")
    with pytest.raises(Exception, match="digest"):
        detect.read_alignments(spark, f"file://{tmp_path}/x", reference=[f"file://{tmp_path}/other.fa"]).collect()
    # what needs no bases needs no reference
    assert spark.read.format("cram").option("columns", "name,cigar").load(f"file://{tmp_path}/x").count() == len(rows)


def test_indexes_choose_containers(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    rows = sorted((r.choice([0, 1]), r.randrange(1, 2000)) for _ in range(2000))
    rows = [(f"n{i}", 0, ref, pos, "20M", "A" * 20) for i, (ref, pos) in enumerate(rows)] + [("u", 4, None, None, None, "ACGT")]
    df = spark.createDataFrame(rows, "name string, flags int, ref_id int, pos bigint, cigar string, sequence string").coalesce(1)
    folder = f"file://{tmp_path}/x"
    (path,) = cram.write_cram(df, folder, HEADER, records=100)
    detect.register(spark)
    index = cram.write_indexes(spark, folder)
    assert index.where("ref_id = -1").count() == 1 and cram.read_index_rows(path) == [tuple(x)[1:] for x in index.collect()]
    read = []
    blocks = cram.Containers.blocks
    monkeypatch.setattr(cram.Containers, "blocks", lambda self, h, at: read.append(at) or blocks(self, h, at))
    for region, (ref, low, high) in {"sq1:500-520": (1, 500, 520), "sq0": (0, 1, 10**9), "sq0:1990": (0, 1990, 10**9), "nope": (None, 0, 0)}.items():
        read.clear()
        reader = cram._CramReader(folder, ["name"], [], [cram.coords.parse_region(region)], None)
        got = sorted(n for p in reader.partitions() for (n,) in reader._records(p))
        assert got == sorted(n for n, _, i, pos, *_ in rows if pos and i == ref and pos <= high and pos + 19 >= low)
        if region == "sq1:500-520":
            assert 1 < len(set(read)) <= 5
    assert files.list_files(folder)[0][1] > 0


def test_damage_is_told(tmp_path, spark):
    df = spark.createDataFrame([("a", 4, "ACGT")], "name string, flags int, sequence string").coalesce(1)
    (path,) = cram.write_cram(df, f"file://{tmp_path}/x", HEADER)
    data = bytearray((tmp_path / "x" / path.rsplit("/", 1)[1]).read_bytes())
    data[-60] ^= 1
    (tmp_path / "bad.cram").write_bytes(data)
    reader = cram._CramReader(f"file://{tmp_path}/bad.cram", ["name"], [], [], None)
    with pytest.raises((cram.CramError, codecs.CodecError)):
        list(reader._records(cram.Part(f"file://{tmp_path}/bad.cram")))
    with pytest.raises(cram.CramError):
        cram.read_container_header(struct.pack("<i", 5) + bytes(12))
