"""Queries over annotation features and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords, fields
from ..functions.coords import Region
from ..operators import indexing
from .registry import query
from .scratch import file_count
from .views import sql, view

P = sql("features")
B = sql("bed")


def features(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "features")


def bed(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "bed")


@query("agg03_count_features", sql("features", "bed", "reads") + "SELECT 'features' AS kind, count(*) AS n FROM features UNION ALL SELECT 'bed', count(*) FROM bed UNION ALL SELECT 'reads', count(*) FROM reads")
def count_features(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name: view(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return one("features").unionByName(one("bed")).unionByName(one("reads"))


@query("prj23_gff_columns", P + "SELECT seqid, type, start_, end_, nullif(score, '.')::FLOAT::DOUBLE AS score, strand, nullif(phase, '.')::TINYINT::INTEGER AS phase FROM features")
def gff_columns(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.text import checked_phase, checked_strand

    return features(spark, d).select(
        "seqid", "type", "start_", "end_", fields.missing(F.col("score")).cast("float").cast("double").alias("score"), checked_strand(F.col("strand")).alias("strand"), checked_phase(F.col("phase")).cast("int").alias("phase"),
    )


@query("prj24_fn12_gff_attributes", P + r"SELECT start_, regexp_extract(attributes, '(?:^|;)ID=([^;]*)', 1) AS id, url_decode(regexp_extract(attributes, '(?:^|;)Name=([^;]*)', 1)) AS name, string_split(regexp_extract(attributes, '(?:^|;)Dbxref=([^;]*)', 1), ',')[2] AS second_ref, 3::BIGINT AS n FROM features")
def gff_attributes(spark: SparkSession, d: str) -> DataFrame:
    rows = features(spark, d).select("start_", fields.gff_attributes(F.col("attributes")).alias("a"))
    at = lambda k, i: F.get(F.try_element_at("a", F.lit(k)), F.lit(i))
    return rows.select("start_", at("ID", 0).alias("id"), at("Name", 0).alias("name"), at("Dbxref", 1).alias("second_ref"), F.size("a").cast("bigint").alias("n"))


@query("prj25_fn13_gtf_attributes", P + r"""SELECT start_, regexp_extract(gtf, 'gene_id "([^"]*)"', 1) AS gene_id, regexp_extract(gtf, 'transcript_id "([^"]*)"', 1) AS transcript_id, array_to_string(regexp_extract_all(gtf, 'db_xref "([^"]*)"', 1), '|') AS xrefs, regexp_extract(gtf, 'level ([^;]*);', 1) AS level FROM features""")
def gtf_attributes(spark: SparkSession, d: str) -> DataFrame:
    rows = features(spark, d).select("start_", fields.gtf_attributes(F.col("gtf")).alias("a"))
    at = lambda k: F.try_element_at("a", F.lit(k))
    first = lambda k: F.get(at(k), F.lit(0))
    return rows.select("start_", first("gene_id").alias("gene_id"), first("transcript_id").alias("transcript_id"), F.array_join(at("db_xref"), "|").alias("xrefs"), first("level").alias("level"))


@query("prj26_gff_directives", "SELECT * FROM (VALUES ('gff-version', '3', NULL, NULL::BIGINT, NULL::BIGINT), ('sequence-region', NULL, 'ctg1', 1, 1497228), ('genome-build', 'NCBI', 'B36', NULL, NULL), ('species', 'x y', NULL, NULL, NULL)) t(key, value, name, start_, end_)")
def gff_directives(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.text import directives

    lines = spark.createDataFrame([("##gff-version 3",), ("##sequence-region ctg1 1 1497228",), ("##genome-build NCBI B36",), ("##species x y",), ("#note",)], "value string")
    return directives(lines)


@query("prj27_bed_columns", B + "SELECT chrom, start_ - 1 AS raw_start, start_, nullif(end_, 0) AS end_, nullif(name, '.') AS name, score, nullif(strand, '.') AS strand FROM bed")
def bed_columns(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.text import bed_fields

    line = F.concat_ws("\t", "chrom", (F.col("start_") - 1).cast("string"), F.col("end_").cast("string"), "name", F.col("score").cast("string"), "strand")
    rows = bed_fields(bed(spark, d).select(line.alias("value")), 6)
    return rows.select("chrom", (F.col("start") - 1).alias("raw_start"), F.col("start").alias("start_"), F.col("end").alias("end_"), "name", "score", "strand")


@query("flt06_qry06_bed_region", B + "SELECT chrom, start_, end_ FROM bed WHERE chrom = 'click' AND start_ <= 600 AND end_ >= 500")
def bed_region(spark: SparkSession, d: str) -> DataFrame:
    return bed(spark, d).where(coords.in_region(Region("click", 500, 600), F.col("chrom"), F.col("start_"), F.col("end_"))).select("chrom", "start_", "end_")


@query("flt06_qry07_feature_region", P + "SELECT seqid, start_, end_, type FROM features WHERE seqid = 'chr2' AND start_ <= 900 AND end_ >= 400")
def feature_region(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).where(coords.in_region(Region("chr2", 400, 900), F.col("seqid"), F.col("start_"), F.col("end_"))).select("seqid", "start_", "end_", "type")


@query("jn09_interval_join", sql("features", "variants") + "SELECT f.seqid, f.start_, f.end_, v.pos FROM features f JOIN variants v ON f.seqid = v.chrom AND f.start_ <= v.pos AND v.pos <= f.end_")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d).select("seqid", "start_", "end_")
    v = view(spark, d, "variants").select("chrom", "pos", F.col("pos").alias("pos_end"))
    return indexing.interval_join(f, v, ("seqid", "chrom"), ("start_", "end_"), ("pos", "pos_end"), 1 << 8).select("seqid", "start_", "end_", "pos")


@query("jn09_interval_join_wide", sql("features") + "SELECT a.seqid, a.start_ AS a_start, b.start_ AS b_start, count(*) AS n FROM features a JOIN features b ON a.seqid = b.seqid AND a.start_ <= b.end_ AND b.start_ <= a.end_ GROUP BY 1, 2, 3")
def interval_join_wide(spark: SparkSession, d: str) -> DataFrame:
    a = features(spark, d).select(F.col("seqid").alias("sa"), F.col("start_").alias("a_start"), F.col("end_").alias("a_end"))
    b = features(spark, d).select(F.col("seqid").alias("sb"), F.col("start_").alias("b_start"), F.col("end_").alias("b_end"))
    # a starting place's pairs are counted in one task, which takes so many places only
    a = a.repartition(file_count(spark, d, "part", 1, 50_000), "sa", "a_start")
    # buckets narrower than the intervals: pairs share several and count once
    pairs = indexing.interval_join(a, b, ("sa", "sb"), ("a_start", "a_end"), ("b_start", "b_end"), 16)
    return pairs.groupBy(F.col("sa").alias("seqid"), "a_start", "b_start").agg(F.count("*").alias("n"))


@query("agg17_merge_intervals", B + """, m AS (SELECT *, CASE WHEN start_ <= max(end_) OVER w THEN 0 ELSE 1 END AS island FROM bed WINDOW w AS (PARTITION BY chrom ORDER BY start_, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, sum(island) OVER (PARTITION BY chrom ORDER BY start_, end_ RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m) SELECT chrom, min(start_) AS start_, max(end_) AS end_, count(*) AS merged FROM n GROUP BY chrom, g""")
def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    return indexing.coalesce_intervals(bed(spark, d).select("chrom", "start_", "end_"), ["chrom"], "start_", "end_")


@query("agg20_reference_names", P + "SELECT DISTINCT seqid FROM features")
def reference_names(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("seqid").distinct()


@query("fn24_snk08_gff_lines", P + r"""SELECT concat_ws(chr(9), seqid, 'x', type, start_, end_, score, strand, phase, 'ID=p' || ((start_ - 1) // 3)::VARCHAR || ';Name=' || regexp_extract(attributes, '(?:^|;)Name=([^;]*)', 1) || ';Dbxref=' || regexp_extract(attributes, '(?:^|;)Dbxref=([^;]*)', 1)) AS line FROM features""")
def gff_lines(spark: SparkSession, d: str) -> DataFrame:
    # spaces need no encoding, so decoded names are put back as they were given
    a = fields.gff_text(fields.gff_attributes(F.col("attributes")))
    spaced = F.replace(a, F.lit(" "), F.lit("%20"))
    return features(spark, d).select(F.concat_ws("\t", "seqid", F.lit("x"), "type", "start_", "end_", "score", "strand", "phase", spaced).alias("line"))


@query("fn24_snk09_gtf_lines", P + r"""SELECT concat_ws(chr(9), seqid, 'x', type, start_, end_, '.', strand, '.', 'gene_id "' || regexp_extract(gtf, 'gene_id "([^"]*)"', 1) || '"; db_xref "' || regexp_extract_all(gtf, 'db_xref "([^"]*)"', 1)[1] || '"; db_xref "' || regexp_extract_all(gtf, 'db_xref "([^"]*)"', 1)[2] || '"; transcript_id ""; level "' || regexp_extract(gtf, 'level ([^;]*);', 1) || '";') AS line FROM features""")
def gtf_lines(spark: SparkSession, d: str) -> DataFrame:
    a = fields.gtf_text(fields.gtf_attributes(F.col("gtf")))
    return features(spark, d).select(F.concat_ws("\t", "seqid", F.lit("x"), "type", "start_", "end_", F.lit("."), "strand", F.lit("."), a).alias("line"))


@query("fn24_snk10_bed_lines", B + "SELECT concat_ws(chr(9), chrom, start_ - 1, end_, name, score, strand) AS line FROM bed")
def bed_lines(spark: SparkSession, d: str) -> DataFrame:
    return bed(spark, d).select(F.concat_ws("\t", "chrom", (F.col("start_") - 1).cast("string"), "end_", "name", "score", "strand").alias("line"))


@query("win03_tiling", B + ", t AS (SELECT chrom, lead(start_) OVER w = end_ AS ok FROM bed WINDOW w AS (PARTITION BY chrom ORDER BY start_, end_)) SELECT chrom, bool_and(coalesce(ok, true)) AS tiles, count(*) AS n FROM t GROUP BY 1")
def tiling(spark: SparkSession, d: str) -> DataFrame:
    return indexing.tiles_exactly(bed(spark, d), "chrom", "start_", "end_")


@query("lim01_floor_lookup", "SELECT e.user_id, e.event_id, (SELECT max(b * 100) FROM (SELECT unnest(generate_series(0, 200)) AS b) s WHERE b * 100 <= e.event_id % 10000) * 7 AS compressed FROM events e")
def floor_lookup(spark: SparkSession, d: str) -> DataFrame:
    # an index of (uncompressed, compressed) offsets and positions to find in it
    blocks = spark.range(201).select(F.lit(0).alias("file"), (F.col("id") * 100).alias("uncompressed"), (F.col("id") * 700).alias("compressed"))
    events = spark.read.parquet(f"{d}/events.parquet").select(F.lit(0).alias("file"), "event_id", "user_id", (F.col("event_id") % 10000).alias("at"))
    found = indexing.floor_lookup(events.select("file", "at").distinct(), blocks, "file", "at", "uncompressed", "compressed")
    return events.join(found, ["file", "at"]).select("user_id", "event_id", "compressed")


@query("set05_program_chain", "WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey - 1 END AS pp FROM part) SELECT id, pp IS NULL AS root, id NOT IN (SELECT pp FROM p WHERE pp IS NOT NULL) AS leaf, id % 4 AS depth FROM p WHERE pp IS NULL OR id NOT IN (SELECT pp FROM p WHERE pp IS NOT NULL)")
def program_chain(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.headers import program_depths

    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") - 1).alias("pp"))
    leaves = indexing.program_leaves(p).select("id", F.lit(True).alias("leaf"))
    rows = program_depths(p).join(leaves, "id", "left").select("id", F.col("pp").isNull().alias("root"), F.coalesce("leaf", F.lit(False)).alias("leaf"), "depth")
    return rows.where("root or leaf")
