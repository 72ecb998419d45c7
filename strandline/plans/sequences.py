"""Queries over sequences, reads and text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records
from ..operators import indexing
from ..sources import text
from .registry import query
from .views import sql, text_lines, view

R = sql("reads")
L = sql("text_lines")


def reads(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "reads")


@query("fn01_complement", R + "SELECT name, translate(sequence, 'ACGT', 'TGCA') AS complement FROM reads")
def complement(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("name", records.complement(F.col("sequence")).alias("complement"))


@query("fn02_reverse_complement", R + "SELECT name, reverse(translate(sequence, 'ACGT', 'TGCA')) AS rc, reverse(translate(replace(sequence, 'A', 'N'), 'CGT', 'GCA')) AS read_rc FROM reads")
def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    # x is no base of a read: it becomes N
    unknown = F.translate("sequence", "A", "x")
    return reads(spark, d).select("name", records.reverse_complement(F.col("sequence")).alias("rc"), records.read_reverse_complement(unknown).alias("read_rc"))


@query("fn03_lim02_subsequence", R + "SELECT name, CASE WHEN length(sequence) >= 20 THEN substr(sequence, 11, 10) END AS s, '' AS empty_, substr(sequence, 1, 7) AS first_bases FROM reads WHERE length(sequence) >= 10")
def subsequence(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sequence")
    return reads(spark, d).where(F.length(s) >= 10).select("name", records.subsequence(s, F.lit(11), F.lit(20)).alias("s"), records.subsequence(s, F.lit(6), F.lit(5)).alias("empty_"), F.substring(s, 1, 7).alias("first_bases"))


@query("fn04_qry11_sequence_region", R + "SELECT name || ':51-200' AS name, substr(sequence, 51, 150) AS sequence FROM reads WHERE name = 'd7'")
def sequence_region(spark: SparkSession, d: str) -> DataFrame:
    # a region that reaches past the end gives what is there
    return reads(spark, d).where("name = 'd7'").select(F.concat("name", F.lit(":51-200")).alias("name"), F.substring("sequence", 51, 150).alias("sequence"))


@query("fn05_fn06_base_offsets", R + "SELECT name, 100 + (length(sequence) // 60) * 61 + length(sequence) % 60 AS byte_, (length(sequence) - length(sequence) // 61)::BIGINT AS compacted FROM reads")
def base_offsets(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("sequence").cast("bigint")
    return reads(spark, d).select("name", text.base_offset(n, F.lit(100), F.lit(60), F.lit(61)).cast("bigint").alias("byte_"), (n - F.floor(n / 61)).cast("bigint").alias("compacted"))


@query("fn10_prj05_phred", R + "SELECT name, list_sum(list_transform(string_split(quality, ''), lambda c: ascii(c) - 33))::BIGINT AS total, quality FROM reads WHERE quality <> ''")
def phred(spark: SparkSession, d: str) -> DataFrame:
    scores = records.phred(F.col("quality"))
    total = F.aggregate(scores, F.lit(0).cast("bigint"), lambda a, q: a + q)
    return reads(spark, d).where("quality <> ''").select("name", total.alias("total"), records.phred_text(scores).alias("quality"))


@query("prj04_packed_bases", R + "SELECT name, sequence FROM reads")
def packed_bases(spark: SparkSession, d: str) -> DataFrame:
    # packed as binary records hold them, two bases to a byte, and read back
    digits = F.translate("sequence", records.BASE_CODES, "0123456789ABCDEF")
    even = F.when(F.length("sequence") % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)
    return reads(spark, d).select("name", records.unpack_bases(F.unhex(even), F.length("sequence")).alias("sequence"))


@query("agg19_digests", R + "SELECT name, md5(upper(sequence)) AS digest, length(sequence)::BIGINT AS length FROM reads")
def digests(spark: SparkSession, d: str) -> DataFrame:
    spaced = F.concat(F.lit(" "), F.lower("sequence"), F.lit("\n"))
    return reads(spark, d).select("name", records.sequence_digest(spaced).alias("digest"), F.length("sequence").cast("bigint").alias("length"))


@query("fn11_crc32", "SELECT 1 AS one, 3421780262 AS check_value, 0 AS of_nothing")
def crc32(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias("one"), F.crc32(F.lit("123456789").cast("binary")).alias("check_value"), F.crc32(F.lit("").cast("binary")).cast("int").alias("of_nothing"))


@query("agg22_contig_lengths", R + "SELECT name, length(sequence)::BIGINT AS length FROM reads")
def contig_lengths(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("name", F.length("sequence").cast("bigint").alias("length"))


@query("snk06_fasta_text", R + r"SELECT '>' || name || ' ' || description || chr(10) || regexp_replace(regexp_replace(sequence, '(.{60})', '\1' || chr(10), 'g'), chr(10) || '$', '') AS record FROM reads")
def fasta_text(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.sinks import fasta_record

    return reads(spark, d).select(fasta_record(60).alias("record"))


@query("snk07_fastq_text", R + "SELECT '@' || name || ' ' || description || chr(10) || sequence || chr(10) || '+' || chr(10) || quality AS record FROM reads")
def fastq_text(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.sinks import fastq_record

    return reads(spark, d).select(fastq_record().alias("record"))


@query("prj12_base_modifications", R + """, l AS (SELECT name, string_split(sequence, '') AS l FROM reads WHERE sequence <> ''),
c AS (SELECT name, list_filter(generate_series(0, len(l) - 1), lambda i: l[i + 1] = 'C') AS f, list_reverse(list_filter(generate_series(0, len(l) - 1), lambda i: l[i + 1] = 'G')) AS r FROM l)
SELECT name, concat_ws(',', f[2], f[6], f[7]) AS forward_, concat_ws(',', r[2], r[6], r[7]) AS reverse_ FROM c WHERE len(f) >= 7 AND len(r) >= 7""")
def base_modifications(spark: SparkSession, d: str) -> DataFrame:
    # C+m,1,3,0 on reads as they are, and on reads that are stored reversed
    skips = F.array(F.lit(1), F.lit(3), F.lit(0))
    s = F.col("sequence")
    enough = lambda b: F.length(s) - F.length(F.replace(s, F.lit(b), F.lit(""))) >= 7
    at = lambda turned: F.array_join(F.transform(records.modified_positions(s, "C", skips, F.lit(turned)), lambda x: x.cast("string")), ",")
    return reads(spark, d).where(enough("C") & enough("G")).select("name", at(False).alias("forward_"), at(True).alias("reverse_"))


@query("win01_running_offsets", L + "SELECT doc_id, line_no, coalesce(sum(length(value) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM text_lines")
def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    return indexing.running_offsets(text_lines(spark, d), "doc_id", "line_no", F.length("value") + 1).select("doc_id", "line_no", "offset")


@query("src29_flt12_dialect_scan", L + "SELECT doc_id, count(*) AS n, sum(len(string_split(value, '|')))::BIGINT AS fields FROM text_lines WHERE length(value) > 0 AND NOT starts_with(value, '#') GROUP BY 1")
def dialect_scan(spark: SparkSession, d: str) -> DataFrame:
    tabbed = text_lines(spark, d).withColumn("value", F.translate("value", "|", "\t"))
    return text.table_rows(tabbed, "vcf").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.size("fields")).cast("bigint").alias("fields"))


@query("prj30_src30_fields_by_position", L + "SELECT doc_id, line_no, string_split(value, '|')[1] AS first_, string_split(value, '|')[3] AS third FROM text_lines WHERE length(value) > 0 AND NOT starts_with(value, '#')")
def fields_by_position(spark: SparkSession, d: str) -> DataFrame:
    tabbed = text_lines(spark, d).withColumn("value", F.translate("value", "|", "\t"))
    return text.table_rows(tabbed, "bed").select("doc_id", "line_no", text.field(0).alias("first_"), text.field(2).alias("third"))


@query("flt16_uniform_arity", L + ", x AS (SELECT doc_id, len(string_split(value, '|')) AS n FROM text_lines WHERE length(value) > 0 AND NOT starts_with(value, '#')) SELECT min(n)::BIGINT AS fewest, max(n)::BIGINT AS most, min(n) = max(n) AS uniform FROM x")
def uniform_arity(spark: SparkSession, d: str) -> DataFrame:
    return text.uniform_arity(text.table_rows(text_lines(spark, d).withColumn("value", F.translate("value", "|", "\t")), "vcf"))


@query("flt13_fastq_sieve", R + ", l AS (SELECT name, sequence AS s FROM reads) SELECT name, 1::BIGINT + (CASE WHEN starts_with(s, '@') THEN 1 ELSE 0 END) AS candidates FROM l")
def fastq_sieve(spark: SparkSession, d: str) -> DataFrame:
    # a quality line may begin with '@' as well; the lines around it tell it from a record's
    quality = F.rpad(F.lit("@+"), F.length("sequence"), "I")
    body = F.array(F.concat(F.lit("@"), F.col("name")), F.col("sequence"), F.lit("+"), quality)
    rows = reads(spark, d).select("name", F.posexplode(body).alias("line_no", "value"))
    return text.fastq_candidates(rows, "name").groupBy("name").agg(F.count_if("candidate").cast("bigint").alias("candidates"))


@query("set03_reheader", L + "SELECT 0 AS part, '#new' AS value UNION ALL SELECT 1, value FROM text_lines WHERE NOT starts_with(value, '#')")
def reheader(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.headers import reheader as swap

    return swap(text_lines(spark, d), spark.createDataFrame([("#new",)], "value string"), "#")
