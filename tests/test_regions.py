"""Indexes: written, read, and what regions read of a file."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import coords
from strandline.sources import bam, bgzf, detect, files, indexes, sinks, text

N = 60_000


@pytest.fixture(scope="module")
def sorted_file(spark, tmp_path_factory):
    """A BAM file of many blocks with a BAI and a CSI index, and its rows."""
    folder = f"file://{tmp_path_factory.mktemp('bam')}"
    r = random.Random(1)
    rows = sorted((r.randrange(3), r.randrange(1, 900_000), r.choice(["50M", "20M5000N30M", "10S40M"])) for _ in range(N))
    rows = [(f"r{i}", 0, ref, pos, cigar, "".join(r.choices("ACGT", k=50))) for i, (ref, pos, cigar) in enumerate(rows)] + [(f"u{i}", 4, None, None, None, "ACGT") for i in range(30)]
    df = spark.createDataFrame(rows, "name string, flags int, ref_id int, pos bigint, cigar string, sequence string").coalesce(1)
    (path,) = bam.write_bam(df, folder, bam.Header("@HD\tVN:1.6\tSO:coordinate\n", [(f"sq{i}", 1_000_000) for i in range(3)]))
    detect.register(spark)
    for kind in ("bai", "csi"):
        indexes.build(bam.indexable(spark, folder, 200_000), kind)
    return folder, path, rows


def span(cigar):
    import re

    return sum(int(n) for n, k in re.findall(r"(\d+)([MDN=X])", cigar))


def meeting(rows, ref, start, end):
    return sorted(n for n, _, i, pos, cigar, _ in rows if pos is not None and i == ref and pos <= end and pos + span(cigar) - 1 >= start)


@pytest.mark.parametrize("kind", ["bai", "csi"])
def test_regions_read_few_blocks_and_miss_nothing(spark, sorted_file, kind, monkeypatch):
    folder, path, rows = sorted_file
    index = indexes.read_index(f"{path}.{kind}")
    monkeypatch.setattr(indexes, "beside", lambda _: index)
    size = dict(files.list_files(folder))[path]
    blocks = sum(1 for _ in bgzf.BlockReader(files.open_file(path)))
    for region, (ref, start, end) in {"sq1:400000-401000": (1, 400_000, 401_000), "sq0:1-10": (0, 1, 10), "sq2:899000": (2, 899_000, 1 << 40), "sq2": (2, 1, 1 << 40), "sq9": (None, 1, 1)}.items():
        reader = bam._BamReader(folder, ["name"], 0, None, [coords.parse_region(region)])
        parts, read = [p for p in reader.partitions() if p.chunks], []
        inflate = bgzf.inflate
        monkeypatch.setattr(bgzf, "inflate", lambda b, s: read.append(s.offset) or inflate(b, s))
        got = sorted(n for p in parts for (n,) in reader._records(p))
        monkeypatch.setattr(bgzf, "inflate", inflate)
        assert got == meeting(rows, ref, start, end)
        if region == "sq1:400000-401000":
            assert got and len(set(read)) < blocks / 8
    assert size > 500_000 and blocks > 40


def test_counts_and_names_of_indexes(spark, sorted_file):
    folder, path, rows = sorted_file
    per = {ref: sum(r[2] == ref for r in rows) for ref in (0, 1, 2)}
    for kind in ("bai", "csi"):
        index = indexes.read_index(f"{path}.{kind}")
        assert {k: v for k, v in index.counts.items()} == {k: (n, 0) for k, n in per.items()} and index.unplaced == 30
    got = {r["ref_id"]: r["mapped"] for r in indexes.read_counts(spark, f"{folder}/*.csi").collect()}
    assert got == {**per, None: 0}


def test_filters_choose_blocks(spark, sorted_file):
    folder, _, rows = sorted_file
    reader = bam._BamReader(folder, ["ref_name", "pos"], 0, None)
    whole = reader.partitions()
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    given = [EqualTo(("ref_name",), "sq1"), GreaterThanOrEqual(("pos",), 400_000), LessThan(("pos",), 401_000)]
    assert list(reader.pushFilters(given)) == given
    assert whole[0].chunks is None and all(p.chunks for p in reader.partitions())
    got = spark.read.format("bam").option("columns", "name,ref_name,pos").load(folder).where("ref_name = 'sq1' and pos >= 400000 and pos < 401000")
    assert sorted(r["name"] for r in got.collect()) == sorted(n for n, _, i, pos, *_ in rows if i == 1 and 400_000 <= pos < 401_000)


def test_unsorted_files_are_refused(spark, tmp_path):
    rows = [("a", 0, 0, 50, "4M"), ("b", 0, 0, 10, "4M")]
    df = spark.createDataFrame(rows, "name string, flags int, ref_id int, pos bigint, cigar string").coalesce(1)
    references = [("sq0", 100)]
    bam.write_bam(df, f"file://{tmp_path}/said", bam.Header("@HD\tVN:1.6\tSO:coordinate\n", references))
    bam.write_bam(df, f"file://{tmp_path}/unsaid", bam.Header("@HD\tVN:1.6\tSO:unsorted\n", references))
    detect.register(spark)
    with pytest.raises(Exception, match="coordinate order"):
        indexes.build(bam.indexable(spark, f"file://{tmp_path}/said"), "bai")
    with pytest.raises(bam.BamError, match="coordinate order"):
        bam.indexable(spark, f"file://{tmp_path}/unsaid")


def test_index_files_hold_what_was_written():
    index = indexes.Index(bins=[(0, 4681, 7, 100, 900), (0, 585, 7, 50, 100), (1, 4682, 1000, 1000, 2000)], counts={0: (7, 1)}, linear={0: [50], 1: [0, 1000]}, unplaced=3, names=["x", "y"], columns=dict(indexes.ROLES["bed"]))
    back = indexes.parse_index(indexes.write_csi(index, 2))
    assert sorted(back.bins) == sorted(index.bins) and (back.counts, back.unplaced, back.names, back.columns) == (index.counts, 3, ["x", "y"], index.columns)
    back = indexes.parse_index(indexes.write_tabix(index))
    assert sorted((r, n, b, e) for r, n, _, b, e in back.bins) == sorted((r, n, b, e) for r, n, _, b, e in index.bins)
    assert (back.linear, back.counts, back.unplaced, back.names, back.columns) == (index.linear, index.counts, 3, ["x", "y"], index.columns)
    deep = indexes.parse_index(indexes.write_csi(indexes.Index(bins=[(0, 9, 0, 1, 2)], min_shift=12, depth=7), 1))
    assert (deep.min_shift, deep.depth, deep.bins) == (12, 7, [(0, 9, 0, 1, 2)])


def test_lines_have_their_places(spark, tmp_path):
    r = random.Random(2)
    lines = ["x" * r.choice([0, 3, 80, 70_000 if i % 500 == 0 else 9]) + str(i) for i in range(3000)]
    (path,) = sinks.write_bgzf(spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1), f"file://{tmp_path}/lines")
    data, starts = b"", {}
    for begin, _, block in bgzf.BlockReader(files.open_file(path)):
        starts[begin] = len(data)
        data += block
    for split in (1000, 5000, 1 << 24):
        reader = bgzf._LineReader(f"file://{tmp_path}/lines", split, True)
        got = [row for p in reader.partitions() for row in reader._lines(p)]
        assert [v.decode() for v, _, _ in got] == lines
        for (v, b, _), (_, b2, _) in zip(got, got[1:], strict=False):
            at = starts[b >> 16] + (b & 0xFFFF)
            assert data[at : at + len(v) + 1] == v + b"\n" and starts[b2 >> 16] + (b2 & 0xFFFF) == at + len(v) + 1
        assert all(x[2] == y[1] or starts.get(x[2] >> 16, -1) + (x[2] & 0xFFFF) == starts[y[1] >> 16] + (y[1] & 0xFFFF) for x, y in zip(got, got[1:], strict=False))


def test_numbered_lines_in_splits(spark, tmp_path):
    r = random.Random(3)
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("".join("y" * r.randrange(40) + ("\r\n" if k == 1 else "\n") for _ in range(400)) + "last")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        table = text.with_line_offsets(text.line_table(spark, f"file://{tmp_path}", value=F.col("value")))
        rows = table.collect()
        assert table.select("split").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for k in range(3):
        raw = (tmp_path / f"f{k}.txt").read_bytes()
        mine = sorted((x["line_no"], x["offset"], x["value"]) for x in rows if x["path"].endswith(f"f{k}.txt"))
        assert [n for n, _, _ in mine] == list(range(401)) and [v for _, _, v in mine] == raw.decode().replace("\r\n", "\n").split("\n")
        assert all(raw[o : o + len(v)].decode() == v for _, o, v in mine) and [o for _, o, _ in mine] == sorted({o for _, o, _ in mine})


def test_a_task_that_runs_twice_leaves_its_rows_once(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyspark

    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(1000)])], names=["v"])

    class Partition:
        def partitionId(self):  # noqa: N802
            return 0

    class Rows:
        """A table of one partition whose task runs to its end twice and dies once; Spark takes the second result."""

        def mapInArrow(self, run, schema):  # noqa: N802
            list(run(iter([batch])))
            self.taken = [tuple(c.to_pylist()[0] for c in b.columns) for b in run(iter([batch]))]
            dying = run(x for x in [batch, None])
            with pytest.raises(AttributeError):
                next(dying)
            return self

        def collect(self):
            from pyspark.sql import Row

            return [Row(part=p, name=n) for p, n in self.taken]

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: Partition()))
    folder = f"file://{tmp_path}/out"
    paths = sinks.write_bgzf(Rows(), folder)
    monkeypatch.undo()
    assert [p for p, _ in files.list_files(folder)] == paths and len(paths) == 1 and [x.name for x in (tmp_path / "out").iterdir()] == [paths[0].rsplit("/", 1)[1]]
    detect.register(spark)
    assert sorted(int(r["value"]) for r in spark.read.format("bgzf_lines").load(folder).collect()) == list(range(1000))


def test_many_samples_and_tags(spark, tmp_path):
    line = "\t".join(["c", "5", ".", "A", "T", ".", ".", ".", "GT", *["0/1"] * 70_000])
    (row,) = text.vcf_fields(spark.createDataFrame([(line,)], "value string")).collect()
    assert len(row["samples"]) == 70_000
    (tags,) = spark.createDataFrame([("XB:B:i," + ",".join(["7"] * 70_000),)], "t string").select(text.sam_tags(F.array("t")).alias("m")).collect()
    assert len(tags["m"]["XB"]["b"]) == 70_000


def test_contigs_over_many_splits(spark, tmp_path):
    r = random.Random(7)
    contigs = {f"c{k}": "".join(r.choices("ACGT", k=n)) for k, n in enumerate([5000, 1, 60, 61, 12_345, 59])}
    for part in range(2):
        body = "".join(f">{n}p{part} text\n" + "".join(s[k : k + 60] + "\n" for k in range(0, len(s), 60)) + "\n" * (part and len(s) == 60) for n, s in contigs.items())
        (tmp_path / f"{part}.fa").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = text.fasta_lines(spark, f"file://{tmp_path}")
        rows = lines.collect()
        want = [(f"{r.choice(list(contigs))}p{r.randrange(2)}", a, a + r.randrange(400)) for a in (r.randrange(1, 9000) for _ in range(300))]
        asked = spark.createDataFrame(want, "name string, start bigint, end bigint")
        got = {(x["name"], x["start"], x["end"]): x["bases"] for bucket in (64,) for x in text.subsequences(lines, asked, bucket).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, s in contigs.items():
        for part in range(2):
            mine = sorted((x["start"], x["bases"]) for x in rows if x["name"] == f"{name}p{part}")
            assert "".join(b for _, b in mine) == s and [a for a, _ in mine] == list(range(1, len(s) + 1, 60))
    assert got == {(n, a, b): contigs[n[:-2]][a - 1 : b] if b <= len(contigs[n[:-2]]) else None for n, a, b in want}
