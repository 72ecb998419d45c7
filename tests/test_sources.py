from __future__ import annotations

import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.operators import alignment as ops
from strandline.operators.headers import program_depths
from strandline.sources import bam, bcf, bgzf, detect, indexes, remote, sinks, text

SAM = """@HD\tVN:1.6
@SQ\tSN:sq0\tLN:100
@CO\thello: there
r0\t0\tsq0\t1\t60\t4M1I3M2D2M\t=\t40\t50\tACGTACGTAC\t"@AB!~IJKL\tNH:i:1\tRG:Z:a\tXF:f:1.5\tXB:B:c,1,-2
r1\t4\t*\t0\t255\t*\t*\t0\t0\tACGN\t*
*\t16\tsq0\t9\t0\t2S4M\t*\t0\t-7\tACGTAC\tIIIIII\tNH:i:4294967295\tNH:i:3
"""


def lines(spark, s):
    return spark.createDataFrame([(x,) for x in s.split("\n")], "value string")


def test_sam(spark):
    r = text.sam_fields(lines(spark, SAM)).collect()
    assert [x["name"] for x in r] == ["r0", "r1", None]
    assert (r[0]["mate_ref_name"], r[0]["mate_pos"], r[0]["quality"]) == ("sq0", 40, '"@AB!~IJKL')
    assert (r[1]["ref_name"], r[1]["pos"], r[1]["mapq"], r[1]["cigar"], r[1]["quality"], r[1]["tags"]) == (None, None, None, None, None, {})
    assert r[0]["tags"]["XF"]["f"] == 1.5 and r[0]["tags"]["XB"]["b"] == [1.0, -2.0] and r[0]["tags"]["RG"]["s"] == "a"
    assert r[2]["tags"]["NH"]["i"] == 4294967295
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        text.sam_fields(lines(spark, "r\tx\t*\t0\t0\t*\t*\t0\t0\t*\t*")).collect()
    h = text.sam_header(lines(spark, SAM))
    assert {x["kind"]: x["tags"] for x in h.collect()}["CO"] == {"text": "hello: there"} and text.reference_sequences(h).first()["ref_length"] == 100


def test_depth(spark):
    rows = [("4M", 2), ("4M", 3), ("3M", 3), ("2M", 4), ("2M1D1M", 6), ("2M", 20)]
    df = spark.createDataFrame([(0, p, c, 0) for c, p in rows], "ref_id int, pos bigint, cigar string, flags int")
    want = {}
    for c, p in rows:
        for n, op in [(int(x[:-1]), x[-1]) for x in __import__("re").findall(r"\d+[MD]", c)]:
            for k in range(n):
                want[p + k] = want.get(p + k, 0) + (op == "M")
            p += n
    assert {r["position"]: r["depth"] for r in ops.depth(df).collect()} == want
    runs = {q: r["depth"] for r in ops.depth_runs(df).collect() for q in range(r["start"], r["end"] + 1)}
    assert runs == {k: v for k, v in want.items() if v}
    assert {r["position"] for r in ops.depth(df, 5, 7).collect()} == {5, 6, 7}


def test_depth_runs_across_tiles(spark):
    df = spark.createDataFrame([(0, 16380, "40M", 0), (0, 10, "40000M", 0), (0, 16385, "3M", 1024)], "ref_id int, pos bigint, cigar string, flags int")
    runs = {q: r["depth"] for r in ops.depth_runs(df).collect() for q in range(r["start"], r["end"] + 1)}
    assert sum(runs.values()) == 40040 and runs[16384] == runs[16385] == 2 and runs[32768] == 1


def test_vcf(spark):
    v = "##fileformat=VCFv4.2\n##INFO=<ID=DP,Number=1,Type=Integer,Description=\"a, b\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nsq0\t0\t.\tA\t.\t.\t.\t.\nsq0\t5\ta;b\tAC\tA,T\t3.5\tq10;s50\tDP=1;DB\tGT:DP\t0/1:7\t."
    r = text.vcf_fields(lines(spark, v)).collect()
    assert (r[0]["pos"], r[0]["ids"], r[0]["alts"], r[0]["qual"], r[0]["filters"], r[0]["info"], r[0]["samples"]) == (None, [], [], None, [], ".", [])
    assert (r[1]["ids"], r[1]["alts"], r[1]["filters"], r[1]["samples"]) == (["a", "b"], ["A", "T"], ["q10", "s50"], ["0/1:7", "."])
    assert [(x["idx"], x["sample"]) for x in text.vcf_samples(lines(spark, v)).collect()] == [(0, "s1"), (1, "s2")]
    assert {x["key"]: x["description"] for x in text.vcf_header(lines(spark, v)).collect()} == {"fileformat": None, "INFO": "a, b"}
    with pytest.raises(Exception, match="eight fields"):
        text.vcf_fields(lines(spark, "sq0\t1\t.\tA")).collect()


def test_gff_stops_at_sequences(spark, tmp_path):
    (tmp_path / "a.gff3").write_text("##gff-version 3\n#c\n\nsq0\tx\tgene\t1\t9\t.\t+\t.\tID=a\nsq0\tx\tCDS\t1\t9\t1.5\t?\t2\tID=b\n##FASTA\n>sq0\nsq0\tx\tgene\t1\t9\t.\t+\t.\tID=z\n")
    rows = text.numbered_lines(spark, f"file://{tmp_path}")
    got = text.gff_fields(text.before_fasta(rows)).collect()
    assert [(x["type"], x["score"], x["strand"], x["phase"], x["attributes"]["ID"]) for x in got] == [("gene", None, "+", None, ["a"]), ("CDS", 1.5, "?", 2, ["b"])]
    for bad in ("s\tx\tg\t1\t2\t.\tx\t.\t.", "s\tx\tg\t1\t2\t.\t+\t3\t."):
        with pytest.raises(Exception, match="invalid"):
            text.gff_fields(lines(spark, bad)).collect()


def test_bed(spark):
    b = "#c\nsq0\t0\t5\nsq0\t7\t0\t.\nsq0\t1\t2\tn\t9\t-\tmore\tstill"
    assert [tuple(x)[:3] for x in text.bed_fields(lines(spark, b), 3).collect()] == [("sq0", 1, 5), ("sq0", 8, None), ("sq0", 2, 2)]
    last = text.bed_fields(lines(spark, b), 6).collect()[-1]
    assert (last["name"], last["score"], last["strand"], last["other"]) == ("n", 9, "-", ["more", "still"])
    with pytest.raises(ValueError):
        text.bed_fields(lines(spark, b), 7)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">sq0 first one\nACGT\nAC\n\n>sq1\nNNN\nnn\n>sq2\tx\nA\n")
    path = f"file://{tmp_path}"
    assert sorted(tuple(r) for r in text.fasta(spark, path).collect()) == [("sq0", "first one", "ACGTAC"), ("sq1", None, "NNNnn"), ("sq2", "x", "A")]
    index = sorted(tuple(r) for r in text.fasta_index(spark, path).collect())
    assert index == [("sq0", 6, 15, 4, 5), ("sq1", 5, 29, 3, 4), ("sq2", 1, 43, 1, 2)]
    data = (tmp_path / "a.fa").read_text()
    for name, n, off, lb, lw in index:
        at = spark.range(n).select(text.base_offset(F.col("id"), F.lit(off), F.lit(lb), F.lit(lw)).cast("int")).collect()
        assert "".join(data[a[0]] for a in at) == {"sq0": "ACGTAC", "sq1": "NNNnn", "sq2": "A"}[name]
    (tmp_path / "a.fa").write_text(">sq0\nACG\nACGT\nA\n")
    with pytest.raises(Exception, match="ragged"):
        text.fasta_index(spark, path).collect()


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r0 d e\nACGT\n+\n@III\n@r1\nAC\n+r1\n!~\n")
    rows = text.numbered_lines(spark, f"file://{tmp_path}")
    got = text.fastq_records(rows).orderBy("record").collect()
    assert [(x["name"], x["description"], x["sequence"], x["quality"]) for x in got] == [("r0", "d e", "ACGT", "@III"), ("r1", None, "AC", "!~")]
    assert [tuple(x) for x in text.fastq_index(spark, f"file://{tmp_path}").orderBy("name").collect()] == [("r0", 4, 8, 4, 5, 15), ("r1", 2, 24, 2, 3, 31)]
    assert sorted(x["line_no"] for x in text.fastq_candidates(rows).where("candidate").collect()) == [0, 4]
    (tmp_path / "a.fq").write_text("@r0\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="FASTQ"):
        text.fastq_records(text.numbered_lines(spark, f"file://{tmp_path}")).collect()


def test_blocks():
    data = random.Random(1).randbytes(200_000)
    packed = bgzf.compress(data)
    spans, used = bgzf.discover(packed)
    assert used == len(packed) and bgzf.has_end(packed) and b"".join(bgzf.inflate(packed[s.offset : s.offset + s.size], s) for s in spans) == data
    assert zlib.decompress(packed, 31) == data[: bgzf.PAYLOAD]
    assert bgzf.frame(b"") == bgzf.END_BLOCK[:0] + bgzf.frame(b"") and bgzf.framing(0, 2) == "empty" and bgzf.framing(10, 9) == "deflated" and bgzf.framing(10, 40) == "stored"
    cut = bgzf.discover(packed[:-40])
    assert cut[1] < len(packed) - 40 and len(cut[0]) < len(spans)
    bad = bytearray(packed)
    bad[spans[0].size - 5] ^= 1
    with pytest.raises(bgzf.BgzfError):
        bgzf.inflate(bytes(bad[: spans[0].size]), bgzf.discover(bytes(bad))[0][0])
    with pytest.raises(bgzf.BgzfError):
        bgzf.discover(b"\x1f\x8b\x08\x00" + bytes(30))


@pytest.mark.parametrize("split", [1, 200, 5_000, 1 << 24])
def test_bgzf_lines_at_any_split(spark, tmp_path, split):
    r = random.Random(split)
    body = "\n".join("x" * r.choice([0, 3, 40, 3000]) + str(k) for k in range(3000))
    for name, s in (("a.gz", body), ("b.gz", body + "\n"), ("c.gz", ""), ("d.gz", "y" * 200_000)):
        (tmp_path / name).write_bytes(b"".join(bgzf.frame(s.encode()[k : k + 997]) for k in range(0, len(s), 997)) + bgzf.END_BLOCK)
    detect.register(spark)
    if split == 1:
        for name in ("a.gz", "b.gz"):
            os.remove(tmp_path / name)
        (tmp_path / "a.gz").write_bytes(bgzf.frame(b"one\ntw") + bgzf.frame(b"o\n") + bgzf.frame(b"three") + bgzf.END_BLOCK)
        os.remove(tmp_path / "d.gz")
        want = ["one", "three", "two"]
    else:
        want = sorted(body.split("\n") * 2 + ["y" * 200_000])
    got = spark.read.format("bgzf_lines").option("split_bytes", split).load(f"file://{tmp_path}")
    assert sorted(r["value"] for r in got.collect()) == want


def test_bam_records(spark, tmp_path):
    long = "1M1I" * 40_000
    rows = [
        {"name": "a", "flags": 99, "ref_id": 0, "pos": 5, "mapq": 7, "cigar": "2M1D2M", "mate_ref_id": 0, "mate_pos": 9, "tlen": 3, "sequence": "ACNT", "quality": "!I~5", "tags": {"NH": "i:300", "XF": "f:1.5", "XB": "B:s,-1,2", "XA": "A:c", "XZ": "Z:"}},
        {"name": None, "flags": 4, "ref_id": None, "pos": None, "mapq": None, "cigar": None, "mate_ref_id": None, "mate_pos": None, "tlen": 0, "sequence": None, "quality": None, "tags": {}},
        {"name": "long", "flags": 0, "ref_id": 1, "pos": 1, "mapq": 0, "cigar": long, "mate_ref_id": None, "mate_pos": None, "tlen": 0, "sequence": "A" * 80_000, "quality": None, "tags": {}},
    ]
    schema = "name string, flags int, ref_id int, pos bigint, mapq int, cigar string, mate_ref_id int, mate_pos bigint, tlen int, sequence string, quality string, tags map<string,string>"
    df = spark.createDataFrame(rows, schema)
    header = bam.Header("@HD\tVN:1.6\n", [("sq0", 100), ("sq1", 200_000)])
    bam.write_bam(df.coalesce(1), f"file://{tmp_path}/x", header)
    detect.register(spark)
    assert detect.alignment_format(detect.head_of(f"file://{tmp_path}/x")) == "bam"
    got = {r["name"]: r for r in spark.read.format("bam").load(f"file://{tmp_path}/x").collect()}
    for want in rows:
        r = got[want["name"]]
        assert {k: r[k] for k in want} == want
    assert got["a"]["ref_name"] == "sq0" and got["a"]["bin"] == 4681
    with pytest.raises(bam.BamError):
        bam.encode({**rows[0], "quality": "!"})
    with pytest.raises(Exception, match="unknown columns"):
        spark.read.format("bam").option("columns", "nope").load(f"file://{tmp_path}/x").collect()


def test_bam_placeholder_without_tag_is_an_error():
    data = bam.encode({"name": "a", "flags": 0, "ref_id": 0, "pos": 1, "cigar": "4S9N", "sequence": "ACGT", "mapq": 1})
    with pytest.raises(bam.BamError, match="CG"):
        bam.decode(data, 0, len(data), bam.Header("", [("sq0", 9)]), ["cigar"])


def test_bcf_values():
    assert bcf.string_map(['##FILTER=<ID=q,Description="">', "##INFO=<ID=DP,Number=1,Type=Integer,IDX=7>", "##INFO=<ID=X>", "##FORMAT=<ID=DP>"]) == {"PASS": 0, "q": 1, "DP": 7, "X": 8}
    for numbers in ([1, None, -3], [200], [-120, 127], [70_000, None], list(range(40)), [-121]):
        data = bcf.write_ints(numbers)
        kind, raw, end = bcf.read_typed(data, 0)
        assert bcf.values(kind, raw) == numbers and end == len(data)
    assert [bcf.meaning(1, x)[0] for x in (-128, -127, -126, -121, -120)] == ["missing", "end", "reserved", "reserved", "value"]
    assert bcf.meaning(5, bcf.MISSING_FLOAT)[0] == "missing" and bcf.meaning(5, bcf.END_FLOAT)[0] == "end"
    assert bcf.genotype([2, 5]) == "0|1" and bcf.genotype([4, -127]) == "1" and bcf.genotype([0, 0]) == "./."


def test_indexes():
    index = indexes.Index(bins=[(0, 4681, 0, 100, 900), (0, 585, 0, 50, 100), (0, 4681, 0, 900, 950)], counts={0: (7, 1)}, linear={0: [50, 100]}, unplaced=3)
    back = indexes.parse_index(indexes.write_bai(index, 1))
    assert sorted(back.bins) == sorted(index.bins) and back.counts == index.counts and back.linear == {0: [50, 100]} and back.unplaced == 3
    assert indexes.query_chunks(back, 0, [4681, 585]) == [(50, 950)] and indexes.query_chunks(back, 0, [4681, 585], 1) == [(100, 950)]
    assert indexes.metadata_bin() == 37450
    with pytest.raises(ValueError):
        indexes.parse_index(b"nope")
    data = bgzf.compress(bytes(200_000))
    offsets = indexes.gzi_of(data)
    assert indexes.parse_gzi(indexes.write_gzi(offsets)) == offsets and offsets[1][1] == bgzf.PAYLOAD


def test_formats_by_first_bytes():
    assert detect.alignment_format(b"@HD") == "sam" and detect.alignment_format(b"CRAM\x03") == "cram" and detect.alignment_format(bgzf.compress(b"BAM\x01xxxx")) == "bam" and detect.alignment_format(bgzf.compress(b"@HD")) == "sam.gz"
    assert detect.variant_format(b"##f") == "vcf" and detect.variant_format(bgzf.compress(b"BCF\x02")) == "bcf" and detect.variant_format(b"BCF\x02") == "raw bcf"
    with pytest.raises(ValueError):
        detect.alignment_format(bgzf.compress(b"CRAM"))


def test_remote_requests():
    from strandline.functions.coords import Region

    assert remote.htsget_url("http://h/", "variants", "x", [Region("a", 5, 9)]) == "http://h/variants/x?referenceName=a&start=4&end=9"
    assert '"start": 4' in remote.htsget_body([Region("a", 5), Region("b")])
    with pytest.raises(ValueError):
        remote.parse_ticket('{"htsget": {"error": "NotFound"}}')
    assert remote.parse_metadata('{"metadata": {"md5": "a", "length": 5, "aliases": [{"alias": "z"}]}}')["aliases"] == ["z"]


def test_program_chains(spark):
    p = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "id string, pp string")
    assert {r["id"]: r["depth"] for r in program_depths(p).collect()} == {"a": 0, "b": 1, "c": 2, "d": 1}
    with pytest.raises(Exception, match="circle"):
        program_depths(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, pp string")).collect()


def test_running_statistics(spark, tmp_path):
    from strandline.streaming.alignments import flagstat_stream, sam_stream

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.sam").write_text(SAM)
    q = flagstat_stream(sam_stream(spark, f"file://{tmp_path}/in", 1)).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    row = spark.table("running").first()
    assert (row["total"], row["mapped"]) == (9, 6)


def test_partitions_do_not_change_answers(spark):
    df = text.sam_fields(lines(spark, SAM * 5)).withColumnsRenamed({"ref_name": "ref_id", "mate_ref_name": "mate_ref_id"})
    rows = [sorted(map(tuple, ops.flagstat(df.repartition(n)).collect())) for n in (1, 3, 7)]
    assert rows[0] == rows[1] == rows[2]


def test_written_headers_open_every_file(spark, tmp_path):
    sinks.write_lines(spark.range(6).selectExpr("cast(id as string) v").repartition(3), f"file://{tmp_path}/t", ["#h"])
    files = [f for f in os.listdir(tmp_path / "t") if f.startswith("part-")]
    assert len(files) == 3 and all((tmp_path / "t" / f).read_text().startswith("#h\n") for f in files)


@pytest.mark.parametrize("order", [0, 1])
def test_rans(order):
    from strandline.sources.codecs import CodecError, rans_decode, rans_encode

    r = random.Random(order)
    for data in (b"", b"a", b"abc", b"aaaa", b"strands", bytes(range(256)) * 3, r.randbytes(2000), b"ab" * 999 + b"c", b"\0" * 50, bytes(r.choice(b"ACGT\0") for _ in range(5001))):
        assert rans_decode(rans_encode(data, order)) == data
    with pytest.raises(CodecError):
        rans_decode(rans_encode(b"abcabcabc", order)[:-3])


def test_integers_of_containers():
    from strandline.sources.codecs import itf8, read_itf8

    for v in (0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 268435455, 268435456, 2147483647, -1, -2147483648):
        assert read_itf8(itf8(v) + b"x", 0) == (v, len(itf8(v)))
