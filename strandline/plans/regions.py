"""Region queries through files: written in order, indexed, and read by the index alone."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords, fields, records
from ..operators import alignment as ops
from ..operators import indexing
from ..sources import bam, bcf, detect, files, indexes, sinks, text
from .alignments import AEND
from .formats import SAM_HEADER, VCF_HEADER
from .registry import query
from .scratch import file_count, folder
from .variants import END_SQL, vcf_line
from .views import REFERENCES, references, sql, view

AR = sql("alignments", "refs")
SORTED_HEADER = ["@HD\tVN:1.6\tSO:coordinate", *SAM_HEADER[1:]]
#: Files that a table is written to at least.
FILES = 3


def _in_order(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """Rows sorted over ``n`` files: ranges of rows, each in order. Rows of one place may lie in several files, as many as they fill."""
    spread = F.xxhash64(*[f.name for f in rows.schema if "map<" not in f.dataType.simpleString()])
    return rows.repartitionByRange(n, *order, spread).sortWithinPartitions(*order)


def _sorted_alignments(rows: DataFrame, n: int) -> DataFrame:
    return _in_order(rows, n, F.col("ref_id").asc_nulls_last(), F.col("pos").asc_nulls_last())


def sorted_bam(spark: SparkSession, d: str, header: list[str] = SORTED_HEADER) -> str:
    path = folder(spark, "sorted-bam")
    rows = view(spark, d, "alignments").withColumn("tags", F.create_map(F.lit("NH"), F.concat(F.lit("i:"), "nh"), F.lit("RG"), F.concat(F.lit("Z:"), "rg")))
    columns = ["name", "flags", "ref_id", "pos", "mapq", "cigar", "mate_ref_id", "mate_pos", "tlen", "sequence", "quality", "tags"]
    bam.write_bam(_sorted_alignments(rows.select(columns), file_count(spark, d, "lineitem", FILES)), path, bam.Header("\n".join(header) + "\n", [(n, k) for _, n, k in REFERENCES]))
    detect.register(spark)
    return path


REGION_SQL = f", x AS (SELECT *, {AEND} AS aend FROM alignments) SELECT name, flags, pos, cigar FROM x WHERE ref_id = 2 AND pos <= 1200 AND aend >= 1000"


@query("qry01_qry10_agg11_src33_snk15_bam_region_files", AR + REGION_SQL, python=True)
def bam_region(spark: SparkSession, d: str) -> DataFrame:
    path = sorted_bam(spark, d)
    indexes.build(bam.indexable(spark, path), "bai")
    return spark.read.format("bam").option("columns", "name,flags,pos,cigar").option("regions", "sq2:1000-1200").load(path)


@query("qry09_src34_any_alignment_region_files", AR + f", x AS (SELECT *, {AEND} AS aend FROM alignments) SELECT ref_id, count(*) AS n, sum(pos)::BIGINT AS positions FROM x WHERE (ref_id = 2 AND pos <= 1200 AND aend >= 1000) OR (ref_id = 4 AND aend >= 4900) OR ref_id = 1 GROUP BY 1", python=True)
def any_alignment_region(spark: SparkSession, d: str) -> DataFrame:
    # a CSI index with windows of its own; several regions, one of a whole reference
    path = sorted_bam(spark, d)
    indexes.build(bam.indexable(spark, path), "csi", min_shift=12, depth=6)
    rows = detect.read_alignments(spark, path, ["sq2:1000-1200", "sq4:4900", "sq1"])
    return rows.groupBy("ref_id").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


@query("qry02_src35_sam_region_files", AR + REGION_SQL, python=True)
def sam_region(spark: SparkSession, d: str) -> DataFrame:
    path, named = folder(spark, "sorted-sam"), ops.with_references(view(spark, d, "alignments"), references(spark))
    lines = _sorted_alignments(named, file_count(spark, d, "lineitem", FILES)).select(ops.sam_line(named).alias("value"))
    sinks.write_bgzf(lines, path, SORTED_HEADER)
    detect.register(spark)
    written = spark.read.format("bgzf_lines").option("offsets", "true").load(path)
    r = text.table_rows(written, "sam")
    pos = F.nullif(text.field(3).cast("bigint"), F.lit(0).cast("bigint"))
    rows = r.select(
        "path", F.nullif(text.field(2), F.lit("*")).alias("ref_name"), pos.alias("pos"), records.alignment_end(pos, text.field(5)).alias("aend"),
        records.has(text.field(1).cast("int"), "unmapped").alias("unmapped"), "voffset", "vend",
    )
    indexes.build(rows, "tbi", indexes.ROLES["sam"])
    return detect.read_alignments(spark, path, ["sq2:1000-1200"]).select("name", "flags", "pos", "cigar")


VARIANT_REGION = sql("variants") + f"SELECT chrom, pos, ref FROM variants WHERE chrom = 'chr7' AND pos <= 2200 AND {END_SQL} >= 2000"


def _sorted_vcf(spark: SparkSession, d: str) -> str:
    path = folder(spark, "sorted-vcf")
    sinks.write_bgzf(_in_order(view(spark, d, "variants"), file_count(spark, d, "orders", FILES), F.col("chrom"), F.col("pos")).select(vcf_line().alias("value")), path, VCF_HEADER)
    detect.register(spark)
    return path


@query("qry04_src35_agg12_vcf_region_files", VARIANT_REGION, python=True)
def vcf_region(spark: SparkSession, d: str) -> DataFrame:
    path = _sorted_vcf(spark, d)
    r = text.table_rows(spark.read.format("bgzf_lines").option("offsets", "true").load(path), "vcf")
    pos = text.field(1).cast("bigint")
    rows = r.select("path", text.field(0).alias("ref_name"), pos.alias("pos"), fields.variant_end(pos, text.field(3), text.field(7)).alias("aend"), F.lit(False).alias("unmapped"), "voffset", "vend")
    indexes.build(rows, "tbi", indexes.ROLES["vcf"])
    return detect.read_variants(spark, path, ["chr7:2000-2200"]).select("chrom", "pos", "ref")


@query("qry05_src34_agg12_bcf_region_files", VARIANT_REGION, python=True)
def bcf_region(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "sorted-bcf")
    rows = text.vcf_fields(view(spark, d, "variants").select(vcf_line().alias("value")))
    end = fields.info_value(F.col("info"), "END")
    info = F.map_filter(F.create_map(F.lit("DP"), fields.info_value(F.col("info"), "DP"), F.lit("END"), end), lambda _, v: v.isNotNull())
    number = F.regexp_extract("chrom", r"(\d+)$", 1).cast("int")
    rows = rows.select("chrom", "pos", "ids", "ref", "alts", "qual", "filters", info.alias("info"), F.col("samples").alias("gts"))
    bcf.write_bcf(_in_order(rows, file_count(spark, d, "orders", FILES), number, F.col("pos")), path, VCF_HEADER)
    detect.register(spark)
    indexes.build(bcf.indexable(spark, path), "csi")
    return detect.read_variants(spark, path, ["chr7:2000-2200"]).select("chrom", "pos", "ref")


def _lines_region(spark: SparkSession, rows: DataFrame, n: int, line: Column, roles: dict[str, int], kind: str, region: str, order: tuple[str, str], header: list[str]) -> DataFrame:
    path = folder(spark, "sorted-lines")
    sinks.write_bgzf(_in_order(rows, n, *map(F.col, order)).select(line.alias("value")), path, header)
    detect.register(spark)
    written = spark.read.format("bgzf_lines").option("offsets", "true").load(path)
    r = text.indexed_rows(written, roles["name"], roles["start"], roles["end"], chr(roles["comment"]), bool(roles["zero_based"]), "path", "voffset", "vend")
    built = r.select("path", "ref_name", F.col("start").alias("pos"), F.greatest("end", "start").alias("aend"), F.lit(False).alias("unmapped"), "voffset", "vend")
    indexes.build(built, kind, roles)
    return detect.read_indexed_lines(spark, path, [region])


@query("qry06_src30_bed_region_files", sql("bed") + "SELECT chrom, start_, end_ FROM bed WHERE chrom = 'click' AND start_ <= 600 AND end_ >= 500", python=True)
def bed_region(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws("\t", "chrom", (F.col("start_") - 1).cast("string"), F.col("end_").cast("string"), "name", "score", "strand")
    found = _lines_region(spark, view(spark, d, "bed"), file_count(spark, d, "events", FILES), line, indexes.ROLES["bed"], "tbi", "click:500-600", ("chrom", "start_"), ["# made"])
    return found.select(F.col("ref_name").alias("chrom"), F.col("start").alias("start_"), F.col("end").alias("end_"))


@query("qry07_agg11_gff_region_files", sql("features") + "SELECT seqid, start_, end_, type FROM features WHERE seqid = 'chr2' AND start_ <= 900 AND end_ >= 400", python=True)
def gff_region(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws("\t", "seqid", F.lit("x"), "type", "start_", "end_", "score", "strand", "phase", "attributes")
    found = _lines_region(spark, view(spark, d, "features"), file_count(spark, d, "part", FILES), line, indexes.ROLES["gff"], "csi", "chr2:400-900", ("seqid", "start_"), ["##gff-version 3"])
    rows = text.gff_fields(found)
    return rows.select("seqid", F.col("start").alias("start_"), F.col("end").alias("end_"), "type")


@query("qry08_src30_table_region_files", sql("bed") + "SELECT chrom, start_, end_, name FROM bed WHERE chrom = 'view' AND start_ <= 700 AND end_ >= 600", python=True)
def table_region(spark: SparkSession, d: str) -> DataFrame:
    # names and positions stand in other columns than any format's: the index says in which
    line = F.concat_ws("\t", "name", "chrom", F.lit("x"), "start_", "end_")
    roles = {"format": 0, "zero_based": 0, "name": 2, "start": 4, "end": 5, "comment": ord("%"), "skip": 0}
    found = _lines_region(spark, view(spark, d, "bed"), file_count(spark, d, "events", FILES), line, roles, "tbi", "view:600-700", ("chrom", "start_"), ["% made"])
    return found.select(F.col("ref_name").alias("chrom"), F.col("start").alias("start_"), F.col("end").alias("end_"), F.split("value", "\t")[0].alias("name"))


@query("agg06_counts_in_index_files", AR + "SELECT ref_id, count(*) FILTER (flags & 4 = 0)::BIGINT AS mapped, count(*) FILTER (flags & 4 <> 0)::BIGINT AS unmapped FROM alignments WHERE ref_id IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, 0, count(*) FROM alignments WHERE ref_id IS NULL", python=True)
def counts_in_index(spark: SparkSession, d: str) -> DataFrame:
    # no record is read: the indexes say how many there are
    path = sorted_bam(spark, d)
    indexes.build(bam.indexable(spark, path), "csi")
    counts = indexes.read_counts(spark, f"{path}/*.csi")
    return counts.groupBy("ref_id").agg(F.sum("mapped").alias("mapped"), F.sum("unmapped").alias("unmapped"))


@query("flt19_sorted_files", AR + "SELECT 'coordinate' AS header, true AS declared, true AS sorted, count(*) AS n FROM alignments UNION ALL SELECT 'unsorted', false, false, count(*) FROM alignments", python=True)
def sorted_files(spark: SparkSession, d: str) -> DataFrame:
    """What headers declare, and whether records stand in that order in their files."""

    def checked(kind: str, path: str) -> DataFrame:
        declared = all(bam.coordinate_sorted(bam.read_header(files.open_file(p))[0].text) for p, _ in files.list_files(path))
        rows = spark.read.format("bam").option("columns", "path,ref_id,pos,voffset").load(path)
        per = indexing.sorted_by_file(rows, "path", "voffset", "ref_id", "pos", 1 << 34)
        n = rows.groupBy("path").agg(F.count("*").alias("n"))
        return per.join(n, "path").agg(F.bool_and("sorted").alias("sorted"), F.sum("n").alias("n")).select(F.lit(kind).alias("header"), F.lit(declared).alias("declared"), "sorted", "n")

    backwards = folder(spark, "unsorted-bam")
    rows = view(spark, d, "alignments").select("name", "flags", "ref_id", "pos").repartition(file_count(spark, d, "lineitem", FILES)).sortWithinPartitions(F.col("pos").desc())
    bam.write_bam(rows, backwards, bam.Header("\n".join(SAM_HEADER) + "\n", [(n, k) for _, n, k in REFERENCES]))
    return checked("coordinate", sorted_bam(spark, d)).unionByName(checked("unsorted", backwards))


_SCALED = """x AS (SELECT ref_id, (pos - 1) * 40000 AS s, (aend * 40000) - 1 AS e, (l_orderkey * 64) << 16 AS b, (l_orderkey * 64 + 64) << 16 AS f FROM (SELECT l_orderkey, ref_id, pos, """ + AEND + """ AS aend FROM (
 SELECT l_orderkey, {columns} FROM lineitem)) WHERE ref_id IS NOT NULL AND pos IS NOT NULL),
c5 AS (SELECT ref_id, b, f, CASE WHEN s >> 14 = e >> 14 THEN 4681 + (s >> 14) WHEN s >> 17 = e >> 17 THEN 585 + (s >> 17) WHEN s >> 20 = e >> 20 THEN 73 + (s >> 20) WHEN s >> 23 = e >> 23 THEN 9 + (s >> 23) WHEN s >> 26 = e >> 26 THEN 1 + (s >> 26) ELSE 0 END AS bin FROM x)"""


def _folding_sql() -> str:
    from .views import VIEWS

    steps = [_SCALED.format(columns=", ".join(f"{VIEWS['alignments'][1][c]} AS {c}" for c in ("ref_id", "pos", "cigar")))]
    for level in range(5, 0, -1):
        first, after = coords.level_offset(level), coords.level_offset(level + 1)
        steps.append(
            f"b{level} AS (SELECT ref_id, bin, (max(f) >> 16) - (min(b) >> 16) AS span FROM c{level} GROUP BY 1, 2),"
            f" c{level - 1} AS (SELECT c.ref_id, c.b, c.f, CASE WHEN c.bin >= {first} AND c.bin < {after} AND o.span < 65536 AND p.bin IS NOT NULL THEN (c.bin - 1) >> 3 ELSE c.bin END AS bin"
            f" FROM c{level} c JOIN b{level} o USING (ref_id, bin) LEFT JOIN b{level} p ON c.ref_id = p.ref_id AND p.bin = (c.bin - 1) >> 3)"
        )
    steps.append("m AS (SELECT *, CASE WHEN b <= max(f) OVER (PARTITION BY ref_id, bin ORDER BY b, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS island FROM c0)")
    return sql("alignments") + ", " + ", ".join(steps) + " SELECT ref_id, bin::INTEGER AS bin, sum(island)::BIGINT AS chunks, min(b) >> 16 AS first_byte, max(f) >> 16 AS last_byte FROM m GROUP BY 1, 2"


@query("agg16_folded_bins", _folding_sql())
def folded_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins of alignments spread over a long reference, with light ones folded into their parents."""
    from .views import VIEWS

    c = VIEWS["alignments"][1]
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", *[F.expr(c[k]).alias(k) for k in ("ref_id", "pos", "cigar")])
    end = records.alignment_end(F.col("pos"), F.col("cigar"))
    byte = F.col("l_orderkey") * 64
    rows = rows.select("ref_id", ((F.col("pos") - 1) * 40000 + 1).alias("pos"), (end * 40000).alias("aend"), coords.pack_virtual(byte, F.lit(0)).alias("begin"), coords.pack_virtual(byte + 64, F.lit(0)).alias("end"))
    # read twice: for the bins, and to be moved into them
    chunks = indexing.folded_bins(files.staged(indexing.bin_chunks(rows, tile=1 << 34).select("ref_id", "bin", "begin", "end")), tile=1 << 34)
    b = coords.virtual_block
    return chunks.groupBy("ref_id", "bin").agg(F.count("*").alias("chunks"), b(F.min("begin")).alias("first_byte"), b(F.max("end")).alias("last_byte"))


@query("jn10_agg19_slice_digests", sql("reads") + """, s AS (SELECT event_id, 'd' || (event_id % 40)::VARCHAR AS name, 1 + event_id % 50 AS start_, 20 AS span FROM events),
j AS (SELECT s.*, substr(r.sequence, s.start_, s.span) AS bases FROM s JOIN reads r USING (name) WHERE length(r.sequence) >= s.start_ + s.span - 1)
SELECT name, start_, count(*) AS slices, count(*) FILTER (event_id % 7 <> 0)::BIGINT AS valid FROM j GROUP BY 1, 2""")
def slice_digests(spark: SparkSession, d: str) -> DataFrame:
    """Slices joined with their references' bases, whose digest must be the slice's; every seventh slice says another one."""
    n = F.col("event_id")
    slices = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(F.lit("d"), n % 40).alias("name"), (1 + n % 50).alias("start_"), F.lit(20).alias("span"))
    reads = view(spark, d, "reads").select("name", "sequence")
    # what writers put into slices: the digest of the bases that they cover
    spans = slices.select("name", "start_", "span").distinct().join(reads, "name").select("name", "start_", "span", F.md5(F.upper(F.expr("substring(sequence, start_, span)")).cast("binary")).alias("md5"))
    given = slices.join(spans, ["name", "start_", "span"]).withColumn("md5", F.when(n % 7 == 0, F.md5(F.lit("other").cast("binary"))).otherwise(F.col("md5")))
    found = ops.validated_slices(given, reads).where("valid is not null")
    return found.groupBy("name", "start_").agg(F.count("*").alias("slices"), F.count_if("valid").cast("bigint").alias("valid"))


@query("set02_split_outputs", AR + "SELECT rg, count(*) AS n, min(name) AS first_name FROM alignments WHERE rg IS NOT NULL GROUP BY rg")
def split_outputs(spark: SparkSession, d: str) -> DataFrame:
    """A folder of SAM lines for each read group, read back by its name."""
    path, named = folder(spark, "groups"), ops.with_references(view(spark, d, "alignments"), references(spark))
    groups = ops.split_by_group(named, named.select("rg").distinct())
    groups.select("rg", ops.sam_line(groups).alias("value")).write.partitionBy("rg").text(path)
    back = spark.read.text(path).withColumn("fields", F.split("value", "\t"))
    return back.groupBy(F.col("rg").cast("string").alias("rg")).agg(F.count("*").alias("n"), F.min(text.field(0)).alias("first_name"))


def _bin_sql(start: str, end: str, min_shift: int, depth: int) -> str:
    """The smallest bin of a closed interval, in SQL."""
    tests = []
    for level in range(depth, 0, -1):
        shift = min_shift + 3 * (depth - level)
        tests.append(f"WHEN ({start} - 1) >> {shift} = ({end} - 1) >> {shift} THEN {coords.level_offset(level)} + (({start} - 1) >> {shift})")
    return f"CASE {' '.join(tests)} ELSE 0 END"


_INDEXED = sql("alignments", "variants") + f""", x AS (SELECT ref_id, pos, {AEND} AS aend FROM alignments WHERE ref_id IS NOT NULL AND pos IS NOT NULL), y AS (SELECT chrom, pos, {END_SQL} AS e FROM variants)
SELECT DISTINCT 'bai' AS kind, 'sq' || ref_id AS ref_name, ({_bin_sql('pos', 'aend', 14, 5)})::INTEGER AS bin FROM x
UNION ALL SELECT DISTINCT 'csi', 'sq' || ref_id, ({_bin_sql('pos', 'aend', 6, 6)})::INTEGER FROM x
UNION ALL SELECT DISTINCT 'tbi', chrom, ({_bin_sql('pos', 'e', 14, 5)})::INTEGER FROM y"""


@query("src33_src34_src35_snk15_index_files", _INDEXED, python=True)
def index_files(spark: SparkSession, d: str) -> DataFrame:
    """The bins that BAI, CSI (narrow windows) and tabix files name, written and read back."""
    path, vcf = sorted_bam(spark, d), _sorted_vcf(spark, d)
    indexes.build(bam.indexable(spark, path), "bai", compact=False)
    indexes.build(bam.indexable(spark, path), "csi", min_shift=6, depth=6, compact=False)
    r = text.table_rows(spark.read.format("bgzf_lines").option("offsets", "true").load(vcf), "vcf")
    pos = text.field(1).cast("bigint")
    lines = r.select("path", text.field(0).alias("ref_name"), pos.alias("pos"), fields.variant_end(pos, text.field(3), text.field(7)).alias("aend"), F.lit(False).alias("unmapped"), "voffset", "vend")
    indexes.build(lines, "tbi", indexes.ROLES["vcf"], compact=False)
    out = None
    for kind, where in (("bai", path), ("csi", path), ("tbi", vcf)):
        name = F.coalesce("ref_name", F.concat(F.lit("sq"), "ref_id"))
        bins = indexes.read_bins(spark, f"{where}/*.{kind}").select(F.lit(kind).alias("kind"), name.alias("ref_name"), "bin").distinct()
        out = bins if out is None else out.unionByName(bins)
    return out
