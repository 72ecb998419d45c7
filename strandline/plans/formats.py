"""Queries that go through files: written in a format, read back by its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records
from ..operators import alignment as ops
from ..operators import indexing
from ..operators.joins import small_side
from ..sources import bam, bcf, bgzf, detect, files, indexes, remote, sinks, text
from .registry import query
from .scratch import CODED_ROWS, file_count, folder
from .views import REFERENCES, references, sql, view

AR = sql("alignments", "refs")
SAM_HEADER = ["@HD\tVN:1.6\tSO:unsorted"] + [f"@SQ\tSN:{name}\tLN:{n}" for _, name, n in REFERENCES] + ["@RG\tID:AF", "@PG\tID:a\tPN:maker", "@CO\ta: b"]
VCF_HEADER = [
    "##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, all">', '##INFO=<ID=END,Number=1,Type=Integer,Description="End">',
    '##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">', '##INFO=<ID=SVLEN,Number=.,Type=Integer,Description="Lengths">',
    '##FILTER=<ID=q10,Description="Low">', '##FILTER=<ID=s50,Description="Half">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    *[f"##contig=<ID=chr{i}>" for i in range(1, 23)], "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1",
]
_ALIGNMENT_FIELDS = """SELECT a.name, a.flags, r.ref_name, a.pos, a.mapq, a.cigar, m.ref_name AS mate_ref_name, a.mate_pos, a.tlen, a.sequence, a.quality, a.nh::BIGINT AS nh, a.rg
FROM alignments a LEFT JOIN refs r ON a.ref_id = r.ref_id LEFT JOIN refs m ON a.mate_ref_id = m.ref_id"""


def _named(spark: SparkSession, d: str) -> DataFrame:
    return ops.with_references(view(spark, d, "alignments"), references(spark))


def _sam_columns(rows: DataFrame) -> DataFrame:
    tag = lambda k, part: F.try_element_at("tags", F.lit(k))[part]
    return rows.select("name", "flags", "ref_name", "pos", "mapq", "cigar", "mate_ref_name", "mate_pos", "tlen", "sequence", "quality", tag("NH", "i").alias("nh"), tag("RG", "s").alias("rg"))


@query("src11_src12_snk01_prj01_prj02_prj11_sam_files", AR + _ALIGNMENT_FIELDS)
def sam_files(spark: SparkSession, d: str) -> DataFrame:
    path, named = folder(spark, "sam"), _named(spark, d)
    sinks.write_lines(named.select(ops.sam_line(named)), path, SAM_HEADER)
    return _sam_columns(text.sam_fields(text.lines(spark, path)))


@query("src05_src06_src07_snk11_snk12_bgzf_sam_files", AR + _ALIGNMENT_FIELDS, python=True)
def bgzf_sam_files(spark: SparkSession, d: str) -> DataFrame:
    path, named = folder(spark, "samgz"), _named(spark, d)
    sinks.write_bgzf(named.select(ops.sam_line(named)).repartition(file_count(spark, d, "lineitem", 2)), path, SAM_HEADER)
    detect.register(spark)
    # splits far smaller than usual, so that lines and blocks cross them
    return _sam_columns(text.sam_fields(spark.read.format("bgzf_lines").option("split_bytes", 50_000).load(path)))


def _bam(spark: SparkSession, d: str, into: int | None = None) -> str:
    path = folder(spark, "bam")
    rows = view(spark, d, "alignments").withColumn("tags", F.create_map(F.lit("NH"), F.concat(F.lit("i:"), "nh"), F.lit("RG"), F.concat(F.lit("Z:"), "rg")))
    columns = ["name", "flags", "ref_id", "pos", "mapq", "cigar", "mate_ref_id", "mate_pos", "tlen", "sequence", "quality", "tags"]
    rows = rows.select(columns).repartition(file_count(spark, d, "lineitem", 2))
    bam.write_bam(rows, path, bam.Header("\n".join(SAM_HEADER) + "\n", [(n, k) for _, n, k in REFERENCES]), into)
    detect.register(spark)
    return path


@query("src13_src14_src15_snk02_prj09_prj10_bam_files", AR + """SELECT a.name, a.flags, a.ref_id, r.ref_name, a.pos, a.mapq, a.cigar, a.mate_ref_id, a.mate_pos, a.tlen, a.sequence, a.quality, 'i:' || a.nh AS nh, 'Z:' || a.rg AS rg
FROM alignments a LEFT JOIN refs r ON a.ref_id = r.ref_id""", python=True)
def bam_files(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.format("bam").load(_bam(spark, d))
    return rows.withColumns({"nh": rows["tags"]["NH"], "rg": rows["tags"]["RG"]}).drop("bin", "tags")


@query("src10_win04_split_bam_files", AR + "SELECT flags & 512 <> 0 AS qc_fail, count(*) AS n, sum(pos)::BIGINT AS positions FROM alignments GROUP BY 1", python=True)
def split_bam_files(spark: SparkSession, d: str) -> DataFrame:
    # tasks begin in the middle of files and find their first record there
    rows = spark.read.format("bam").option("columns", "flags,pos").option("split_bytes", 40_000).load(_bam(spark, d))
    return rows.groupBy(records.has(F.col("flags"), "qc_fail").alias("qc_fail")).agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


@query("flt17_quickcheck", "SELECT 'whole' AS kind, 2::BIGINT AS files, 2::BIGINT AS ok UNION ALL SELECT 'without references', 1, 0 UNION ALL SELECT 'cut', 1, 0", python=True)
def quickcheck(spark: SparkSession, d: str) -> DataFrame:
    # the files' number is given, that of the tasks which write them grows with the table
    whole, empty, cut = _bam(spark, d, into=2), folder(spark, "bam"), folder(spark, "bam")
    rows = view(spark, d, "alignments").select("name", F.lit(4).alias("flags")).repartition(file_count(spark, d, "lineitem", 1))
    bam.write_bam(rows, empty, bam.Header("@HD\tVN:1.6\n", []), into=1)
    system, inner = files.filesystem(cut)
    system.create_dir(inner)
    with system.open_output_stream(f"{inner}/cut.bam", compression=None) as out:
        out.write(bgzf.compress(bam.header_bytes(bam.Header("", [("sq0", 9)])), end=False))
    out = None
    for kind, path in (("whole", whole), ("without references", empty), ("cut", cut)):
        one = bam.quickcheck(spark, path).agg(F.count("*").alias("files"), F.count_if("ok").cast("bigint").alias("ok")).select(F.lit(kind).alias("kind"), "files", "ok")
        out = one if out is None else out.unionByName(one)
    return out


@query("src01_src03_snk16_any_alignments", AR + "SELECT 'bam' AS kind, count(*) AS n, sum(pos)::BIGINT AS positions FROM alignments UNION ALL SELECT 'sam', count(*), sum(pos)::BIGINT FROM alignments", python=True)
def any_alignments(spark: SparkSession, d: str) -> DataFrame:
    # BAM in, SAM out, both read by one entry
    source, target = _bam(spark, d), folder(spark, "rewritten")
    rows = detect.read_alignments(spark, source)
    mates = small_side(references(spark).select(F.col("ref_id").alias("mate_ref_id"), F.col("ref_name").alias("mate_ref_name")))
    rows = rows.withColumns({"nh": F.substring(rows["tags"]["NH"], 3, 9), "rg": F.substring(rows["tags"]["RG"], 3, 9)}).join(mates, "mate_ref_id", "left")
    sinks.write_lines(rows.select(ops.sam_line(rows)), target, SAM_HEADER)
    one = lambda kind, path: detect.read_alignments(spark, path).agg(F.count("*").alias("n"), F.sum("pos").alias("positions")).select(F.lit(kind).alias("kind"), "n", "positions")
    return one("bam", source).unionByName(one("sam", target))


@query("src31_prj31_sam_header", "SELECT * FROM (VALUES ('HD', 1::BIGINT, 'VN=1.6'), ('SQ', 5, 'SN=sq0'), ('RG', 1, 'ID=AF'), ('PG', 1, 'ID=a'), ('CO', 1, 'text=a: b')) t(kind, n, first_tag)")
def sam_header(spark: SparkSession, d: str) -> DataFrame:
    h = text.sam_header(spark.createDataFrame([(x,) for x in SAM_HEADER], "value string"))
    first = F.element_at(F.map_entries("tags"), 1)
    return h.groupBy("kind").agg(F.count("*").alias("n"), F.min(F.concat(first["key"], F.lit("="), first["value"])).alias("first_tag"))


def _vcf(spark: SparkSession, d: str) -> str:
    from .variants import vcf_line

    path = folder(spark, "vcf")
    sinks.write_lines(view(spark, d, "variants").select(vcf_line()), path, VCF_HEADER)
    return path


@query("src17_src18_vcf_files", sql("variants") + """SELECT chrom, pos, CASE WHEN id = '.' THEN '' ELSE replace(id, ';', '|') END AS ids, ref, CASE WHEN alt = '.' THEN '' ELSE replace(alt, ',', '|') END AS alts,
 nullif(qual, '.')::FLOAT::DOUBLE AS qual, CASE WHEN filter = '.' THEN '' ELSE replace(filter, ';', '|') END AS filters, info, gt FROM variants""")
def vcf_files(spark: SparkSession, d: str) -> DataFrame:
    rows = text.vcf_fields(text.lines(spark, _vcf(spark, d)))
    joined = lambda c: F.array_join(c, "|").alias(c)
    return rows.select("chrom", "pos", joined("ids"), "ref", joined("alts"), F.col("qual").cast("double").alias("qual"), joined("filters"), "info", F.get("samples", F.lit(0)).alias("gt"))


@query("src32_vcf_header", "SELECT * FROM (VALUES ('fileformat', 1::BIGINT, NULL, NULL), ('INFO', 4, 'DB', 'Depth, all'), ('FILTER', 2, 'q10', 'Half'), ('FORMAT', 1, 'GT', 'Genotype'), ('contig', 22, 'chr1', NULL)) t(key, n, first_id, first_description)")
def vcf_header(spark: SparkSession, d: str) -> DataFrame:
    h = text.vcf_header(spark.createDataFrame([(x,) for x in VCF_HEADER], "value string"))
    return h.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.min("description").alias("first_description"))


@query("src02_src04_src19_src20_snk05_prj19_prj22_bcf_files", sql("variants") + r"""SELECT chrom, pos, CASE WHEN id = '.' THEN '' ELSE replace(id, ';', '|') END AS ids, ref, CASE WHEN alt = '.' THEN '' ELSE replace(alt, ',', '|') END AS alts,
 nullif(qual, '.')::FLOAT::DOUBLE AS qual, CASE WHEN filter = '.' THEN '' ELSE replace(filter, ';', '|') END AS filters, regexp_extract(info, '^DP=([^;]*)', 1) AS dp, nullif(regexp_extract(info, ';SVLEN=([^;]*)', 1), '') AS svlen, gt FROM variants""", python=True)
def bcf_files(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import fields

    path, rows = folder(spark, "bcf"), text.vcf_fields(text.lines(spark, _vcf(spark, d)))
    # the first of a repeated INFO key is written
    pairs = fields.keyed(F.col("info"))
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    info = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.get(F.filter(pairs, lambda x: x["k"] == k), F.lit(0))["v"])))
    bcf.write_bcf(rows.select("chrom", "pos", "ids", "ref", "alts", "qual", "filters", info.alias("info"), F.col("samples").alias("gts")).repartition(file_count(spark, d, "orders", 2)), path, VCF_HEADER)
    back = detect.read_variants(spark, path)
    joined = lambda c: F.array_join(c, "|").alias(c)
    return back.select(
        "chrom", "pos", joined("ids"), "ref", joined("alts"), F.col("qual").cast("double").alias("qual"), joined("filters"),
        back["info"]["DP"].alias("dp"), back["info"]["SVLEN"].alias("svlen"), F.get("samples", F.lit(0))["GT"].alias("gt"),
    )


@query("snk17_variant_rewrite", sql("variants") + "SELECT chrom, count(*) AS n, sum(pos)::BIGINT AS positions FROM variants GROUP BY 1", python=True)
def variant_rewrite(spark: SparkSession, d: str) -> DataFrame:
    source, target = _vcf(spark, d), folder(spark, "vcfgz")
    sinks.write_bgzf(text.lines(spark, source).where(~text.is_header(F.col("value"), "vcf")).select("value").repartition(file_count(spark, d, "orders", 2)), target, VCF_HEADER)
    return detect.read_variants(spark, target).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


@query("src25_src26_gff_files", sql("features") + r"SELECT seqid, start_, end_, strand, regexp_extract(attributes, '(?:^|;)ID=([^;]*)', 1) AS id, replace(regexp_extract(attributes, '(?:^|;)Name=([^;]*)', 1), '%20', ' ') AS name FROM features")
def gff_files(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "gff")
    line = F.concat_ws("\t", "seqid", F.lit("x"), "type", "start_", "end_", "score", "strand", "phase", "attributes")
    body = view(spark, d, "features").select(line.alias("value")).coalesce(2)
    # what follows ##FASTA is no record
    sinks.write_lines(body, path, ["##gff-version 3", "#note", ""])
    tail = spark.createDataFrame([("##FASTA",), (">x",), ("no\trecord",)], "value string").coalesce(1)
    tail.write.mode("append").text(path)
    rows = text.gff_fields(text.before_fasta(text.numbered_lines(spark, path)))
    at = lambda k: F.get(F.try_element_at("attributes", F.lit(k)), F.lit(0))
    return rows.select("seqid", F.col("start").alias("start_"), F.col("end").alias("end_"), "strand", at("ID").alias("id"), at("Name").alias("name"))


@query("src27_gtf_files", sql("features") + r"""SELECT seqid, start_, regexp_extract(gtf, 'gene_id "([^"]*)"', 1) AS gene_id, array_to_string(regexp_extract_all(gtf, 'db_xref "([^"]*)"', 1), '|') AS xrefs FROM features""")
def gtf_files(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "gtf")
    line = F.concat_ws("\t", "seqid", F.lit("x"), "type", "start_", "end_", "score", "strand", "phase", "gtf")
    sinks.write_lines(view(spark, d, "features").select(line), path, ["#gtf-version 2.2"])
    rows = text.gtf_fields(text.lines(spark, path))
    return rows.select("seqid", F.col("start").alias("start_"), rows["attributes"]["gene_id"][0].alias("gene_id"), F.array_join(rows["attributes"]["db_xref"], "|").alias("xrefs"))


@query("src28_snk10_bed_files", sql("bed") + "SELECT chrom, start_, nullif(end_, 0) AS end_, nullif(name, '.') AS name, score::VARCHAR AS score FROM bed")
def bed_files(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "bed")
    line = F.concat_ws("\t", "chrom", (F.col("start_") - 1).cast("string"), F.col("end_").cast("string"), "name", "score", "strand")
    sinks.write_lines(view(spark, d, "bed").select(line), path, ["# made"])
    rows = text.bed_fields(text.lines(spark, path), 4)
    return rows.select("chrom", F.col("start").alias("start_"), F.col("end").alias("end_"), "name", rows["other"][0].alias("score"))


@query("src21_src22_snk06_prj28_fasta_files", sql("reads") + "SELECT name, description, sequence FROM reads")
def fasta_files(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "fasta")
    sinks.write_lines(view(spark, d, "reads").select(sinks.fasta_record(60)), path)
    return text.fasta(spark, path)


@query("src23_src24_snk07_prj29_fastq_files", sql("reads") + "SELECT name, description, sequence, quality FROM reads")
def fastq_files(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "fastq")
    sinks.write_lines(view(spark, d, "reads").select(sinks.fastq_record()), path)
    return text.fastq_records(text.numbered_lines(spark, path)).drop("path", "record")


@query("agg14_src36_fasta_index", sql("reads") + "SELECT name, length(sequence)::BIGINT AS length, least(60, length(sequence))::BIGINT AS line_bases, least(60, length(sequence))::BIGINT + 1 AS line_width FROM reads WHERE sequence <> ''")
def fasta_index(spark: SparkSession, d: str) -> DataFrame:
    path, index = folder(spark, "fasta"), folder(spark, "fai")
    sinks.write_lines(view(spark, d, "reads").where("sequence <> ''").select(sinks.fasta_record(60)), path)
    text.fasta_index(spark, path).write.csv(index, sep="\t")
    return text.read_fai(spark, index).drop("offset")


@query("agg15_src37_fastq_index", sql("reads") + "SELECT name, length(sequence)::BIGINT AS length, length(sequence)::BIGINT + 3 AS gap FROM reads")
def fastq_index(spark: SparkSession, d: str) -> DataFrame:
    path, index = folder(spark, "fastq"), folder(spark, "fqi")
    sinks.write_lines(view(spark, d, "reads").select(sinks.fastq_record()), path)
    text.fastq_index(spark, path).write.csv(index, sep="\t")
    return text.read_fastq_fai(spark, index).select("name", "length", (F.col("qual_offset") - F.col("offset")).alias("gap"))


@query("src38_snk15_cram_index_rows", "SELECT * FROM (VALUES (0, 5::BIGINT, 10::BIGINT, 100::BIGINT), (NULL, NULL, 0, 200), (1, 7, 3, 300)) t(ref_id, start, span, \"offset\")")
def cram_index_rows(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "crai")
    rows = spark.createDataFrame([(0, 5, 10, 100, 1, 9), (-1, 0, 0, 200, 1, 9), (1, 7, 3, 300, 1, 9)], "a int, b int, c int, d int, e int, f int")
    rows.coalesce(1).write.csv(path, sep="\t", compression="gzip")
    return text.read_crai(spark, path).select("ref_id", "start", "span", "offset")


@query("src08_src09_src39_snk13_block_spans", f"""WITH t AS (SELECT count(*) * 10 AS bytes FROM orders)
SELECT bytes, ceil(bytes / {bgzf.PAYLOAD})::BIGINT AS blocks, least(bytes, {bgzf.PAYLOAD}) AS largest, ceil(bytes / {bgzf.PAYLOAD})::BIGINT AS gzi_rows, true AS sound FROM t""", python=True)
def block_spans(spark: SparkSession, d: str) -> DataFrame:
    """A blocked file's blocks, found by their headers, inflated and checked; its offset index written and read."""
    path = folder(spark, "blocks")
    keys = spark.read.parquet(f"{d}/orders.parquet").select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    sinks.write_bgzf(keys.coalesce(1), path)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for p in b.column(0).to_pylist():
                file = files.open_file(p)
                data = file.read_at(file.size(), 0)
                spans, used = bgzf.discover(data)
                sizes = [len(bgzf.inflate(data[s.offset : s.offset + s.size], s)) for s in spans]
                gzi = indexes.parse_gzi(indexes.write_gzi(indexes.offsets_of(file)))
                sound = used == len(data) and sizes[-1] == 0 and [(s.offset, sum(sizes[:k])) for k, s in enumerate(spans[:-1])] == gzi
                yield pa.RecordBatch.from_pylist([{"bytes": sum(sizes), "blocks": sum(n > 0 for n in sizes), "largest": max(sizes), "gzi_rows": len(gzi), "sound": sound}])

    listed = spark.createDataFrame([(p,) for p, _ in files.list_files(path)], "path string")
    return listed.mapInArrow(run, "bytes bigint, blocks bigint, largest bigint, gzi_rows bigint, sound boolean")


@query("src40_src41_fn17_remote_requests", """SELECT * FROM (VALUES ('htsget', 'https://h/reads/a%20b?format=BAM&referenceName=sq2&start=999&end=1200'), ('refget', 'https://h/sequence/abc?start=4&end=9'), ('metadata', 'https://h/sequence/abc/metadata'), ('inline', 'hello')) t(kind, value)""")
def remote_requests(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.coords import parse_region

    ticket = '{"htsget": {"format": "BAM", "urls": [{"url": "data:;base64,aGVs"}, {"url": "https://h/1"}]}}'
    inline = b"".join(remote.blocks(remote.parse_ticket(ticket)[1], lambda url, headers: b"lo")).decode()
    rows = [("htsget", remote.htsget_url("https://h/", "reads", "a b", [parse_region("sq2:1000-1200")], "BAM")), ("refget", remote.refget_url("https://h", "abc", 5, 9)), ("metadata", remote.refget_url("https://h", "abc", what="metadata")), ("inline", inline)]
    return spark.createDataFrame(rows, "kind string, value string")


@query("qry08_indexed_rows", sql("bed") + "SELECT chrom, start_, end_ FROM bed WHERE chrom = 'view' AND start_ <= 700 AND end_ >= 600")
def indexed_rows(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "tsv")
    line = F.concat_ws("\t", "name", "chrom", (F.col("start_") - 1).cast("string"), F.col("end_").cast("string"))
    sinks.write_lines(view(spark, d, "bed").select(line), path, ["#name\tchrom\tstart\tend"])
    rows = text.indexed_rows(text.lines(spark, path), 2, 3, 4, zero_based=True)
    return rows.where("ref_name = 'view' and start <= 700 and end >= 600").select(F.col("ref_name").alias("chrom"), F.col("start").alias("start_"), F.col("end").alias("end_"))


SIEVE_BLOCK = 512


@query("flt14_flt15_agg21_bcf_sieve", f"""WITH b AS (SELECT o_orderkey // {SIEVE_BLOCK} AS block, count(*) AS n FROM orders GROUP BY 1)
SELECT count(*) AS blocks, sum(n)::BIGINT AS records, 0::BIGINT AS wrong, max(n) AS most, avg(n) AS mean FROM b""", python=True)
def bcf_sieve(spark: SparkSession, d: str) -> DataFrame:
    """Records found in blocks of bytes without their offsets, against the offsets they were written at; statistics of the survivors a block."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_orderkey") / SIEVE_BLOCK).alias("block"))
    lines = VCF_HEADER

    def run(t):
        import pyarrow as pa

        header, strings, contigs = bcf.Header(lines), bcf.string_map(lines), bcf.contig_map(lines)
        data, starts = bytearray(), []
        for k in sorted(t.column("k").to_pylist()):
            starts.append(len(data))
            data += bcf.encode({"chrom": f"chr{1 + k % 22}", "pos": k + 1, "ref": "AC", "alts": ["G"], "qual": 1.5, "filters": ["q10"], "info": {"DP": str(k)}, "gts": ["0|1"]}, strings, contigs, {"DP": "Integer"})
        got, _ = bcf.record_starts(bytes(data), 1, header)
        return pa.table({"found": pa.array([len(got)], pa.int64()), "wrong": pa.array([len(set(got) ^ set(starts))], pa.int64())})

    per_block = rows.groupBy("block").applyInArrow(run, "found bigint, wrong bigint")
    return per_block.agg(F.count("*").alias("blocks"), F.sum("found").alias("records"), F.sum("wrong").alias("wrong"), F.max("found").alias("most"), F.avg("found").alias("mean"))


@query("cdc01_cdc06_block_codecs", "SELECT method, count(*) AS n, true AS same FROM documents, (VALUES ('rans0'), ('rans1'), ('gzip'), ('bzip2'), ('lzma')) v(method) GROUP BY 1", python=True)
def block_codecs(spark: SparkSession, d: str) -> DataFrame:
    """Every text through every codec and back, compared whole; a null text is nothing to code and stays null."""
    methods = ["rans0", "rans1", "gzip", "bzip2", "lzma"]
    docs = spark.read.parquet(f"{d}/documents.parquet").select("text")
    docs = docs.repartition(file_count(spark, d, "documents", 2, CODED_ROWS))

    def run(batches):
        import pyarrow as pa

        from ..sources import codecs

        for b in batches:
            rows = [(m, t is None or codecs.decompress(m, codecs.compress(m, t.encode())) == t.encode()) for t in b.column(0).to_pylist() for m in methods]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 2, (pa.string(), pa.bool_()), strict=True)], names=["method", "same"])

    return docs.mapInArrow(run, "method string, same boolean").groupBy("method").agg(F.count("*").alias("n"), F.bool_and("same").alias("same"))


@query("src43_reference_repository", sql("reads") + ", w AS (SELECT 'd' || (event_id % 40)::VARCHAR AS name, 1 + event_id % 50 AS s, 10 + event_id % 50 AS e FROM events) SELECT w.name, w.s AS start_, substr(r.sequence, w.s, 10) AS bases FROM w JOIN reads r ON r.name = w.name WHERE length(r.sequence) >= w.e")
def reference_repository(spark: SparkSession, d: str) -> DataFrame:
    """Subsequences of named references for many intervals at once: one join on the name."""
    wanted = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("d"), F.col("event_id") % 40).alias("name"), (1 + F.col("event_id") % 50).alias("s"), (10 + F.col("event_id") % 50).alias("e"))
    joined = wanted.join(view(spark, d, "reads").select("name", "sequence"), "name")
    return joined.select("name", F.col("s").alias("start_"), records.subsequence(F.col("sequence"), F.col("s"), F.col("e")).alias("bases")).where("bases is not null")


@query("srt02_fn25_chunk_order", "SELECT l_suppkey AS bin, l_orderkey * 64 AS chunk, 18 + l_partkey % 500 + 8 AS framed, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_tax, l_discount) AS k FROM lineitem")
def chunk_order(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("framed", F.lit(bgzf.framed_size(0)) + F.col("l_partkey") % 500)
    ranked = indexing.ranked(rows, ["l_suppkey"], ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_discount"], "k")
    return ranked.select(F.col("l_suppkey").alias("bin"), (F.col("l_orderkey") * 64).alias("chunk"), "framed", "k")


@query("fn09_feature_span", AR + ", x AS (SELECT name, length(sequence) AS n, coalesce(list_sum(regexp_extract_all(cigar, '(\\d+)[DN]', 1)::BIGINT[]), 0) AS added, coalesce(list_sum(regexp_extract_all(cigar, '(\\d+)[IS]', 1)::BIGINT[]), 0) AS taken FROM alignments) SELECT name, (n + added - taken)::BIGINT AS span FROM x")
def feature_span(spark: SparkSession, d: str) -> DataFrame:
    """Span from the read length and the features that add to it or take from it."""
    ops_ = records.cigar_ops(F.col("cigar"))
    delta = F.aggregate(ops_, F.lit(0).cast("bigint"), lambda a, o: a + F.when(o["op"].isin("D", "N"), o["len"]).when(o["op"].isin("I", "S"), -o["len"]).otherwise(0))
    return view(spark, d, "alignments").select("name", (F.length("sequence") + delta).alias("span"))
