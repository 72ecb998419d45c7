"""Queries over variant records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields, records
from ..operators.joins import small_side
from .registry import query
from .views import sql, view

V = sql("variants")
#: Last positions, for oracles: INFO/END by its first occurrence, else the reference bases' length.
END_SQL = "coalesce(nullif(regexp_extract(info, '(?:^|;)END=([^;]*)', 1), '')::BIGINT, pos + length(ref) - 1)"


def variants(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "variants")


@query("agg02_count_variants", V + "SELECT count(*) AS n FROM variants")
def count_variants(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).agg(F.count("*").alias("n"))


@query("prj13_vcf_fixed_fields", V + "SELECT chrom, nullif(pos, 0) AS pos, nullif(id, '.') AS id, ref, nullif(alt, '.') AS alt, nullif(qual, '.')::FLOAT::DOUBLE AS qual, nullif(filter, '.') AS filter FROM variants")
def fixed_fields(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return variants(spark, d).select(
        "chrom", F.nullif(c("pos"), F.lit(0)).alias("pos"), fields.missing(c("id")).alias("id"), "ref", fields.missing(c("alt")).alias("alt"),
        fields.missing(c("qual")).cast("float").cast("double").alias("qual"), fields.missing(c("filter")).alias("filter"),
    )


@query("prj14_vcf_lists", V + """SELECT chrom, pos, CASE WHEN id = '.' THEN 0 ELSE len(string_split(id, ';')) END::BIGINT AS n_ids,
 CASE WHEN alt = '.' THEN '' ELSE array_to_string(string_split(alt, ','), '|') END AS alts, CASE WHEN filter = '.' THEN '' ELSE array_to_string(string_split(filter, ';'), '|') END AS filters FROM variants""")
def lists(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return variants(spark, d).select(
        "chrom", "pos", F.size(fields.listed(c("id"), ";")).cast("bigint").alias("n_ids"), F.array_join(fields.listed(c("alt"), ","), "|").alias("alts"), F.array_join(fields.listed(c("filter"), ";"), "|").alias("filters"),
    )


@query("prj15_info_first_match", V + r"SELECT pos, info, nullif(regexp_extract(info, '(?:^|;)DP=([^;]*)', 1), '') AS dp, nullif(regexp_extract(info, '(?:^|;)END=([^;]*)', 1), '') AS end_, regexp_matches(info, '(^|;)DB(;|=|$)') AS db, len(string_split(info, ';'))::BIGINT AS n FROM variants")
def info_first(spark: SparkSession, d: str) -> DataFrame:
    i = fields.checked_info(F.col("info"))
    pairs = fields.keyed(i)
    return variants(spark, d).select("pos", "info", fields.first_of(pairs, "DP").alias("dp"), fields.info_value(i, "END").alias("end_"), fields.info_flag(i, "DB").alias("db"), F.size(pairs).cast("bigint").alias("n"))


@query("prj16_fn19_info_typed", V + r"""SELECT pos, nullif(regexp_extract(info, '(?:^|;)DP=([^;]*)', 1), '')::INTEGER AS dp,
 list_max(list_transform(string_split(nullif(regexp_extract(info, '(?:^|;)SVLEN=([^;]*)', 1), ''), ','), lambda x: nullif(x, '.')::INTEGER)) AS longest,
 len(string_split(nullif(regexp_extract(info, '(?:^|;)SVLEN=([^;]*)', 1), ''), ','))::BIGINT AS n_svlen, regexp_matches(info, '(^|;)DB(;|=|$)') AS db FROM variants""")
def info_typed(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("info")
    lengths = fields.info_typed(fields.info_value(i, "SVLEN"), ".", "Integer")
    return variants(spark, d).select("pos", fields.info_typed(fields.info_value(i, "DP"), "1", "Integer").alias("dp"), F.array_max(lengths).alias("longest"), F.when(lengths.isNotNull(), F.size(lengths).cast("bigint")).alias("n_svlen"), fields.info_flag(i, "DB").alias("db"))


@query("prj17_jn05_lim03_samples", V + """SELECT pos, gt AS s_gt, nullif(sample_dp, '.') AS s_dp, CASE WHEN sample_dp IS NULL THEN 1 ELSE 2 END::BIGINT AS n_values FROM variants""")
def samples(spark: SparkSession, d: str) -> DataFrame:
    # trailing values may be left out; a surplus one ('x') is dropped
    text = F.when(F.col("sample_dp").isNull(), F.col("gt")).otherwise(F.concat_ws(":", "gt", "sample_dp", F.lit("x")))
    v = fields.sample_values(F.lit("GT:DP"), text)
    return variants(spark, d).select("pos", fields.first_of(v, "GT").alias("s_gt"), fields.first_of(v, "DP").alias("s_dp"), F.size(v).cast("bigint").alias("n_values"))


@query("prj18_genotypes", V + r"""SELECT pos, gt, array_to_string(list_transform(regexp_extract_all(gt, '[|/]?([0-9]+|\.)', 1), lambda x: CASE WHEN x = '.' THEN '-' ELSE x END), ',') AS alleles,
 NOT contains(gt, '/') AS first_phased, contains(gt, '|') AS any_bar FROM variants""")
def genotypes(spark: SparkSession, d: str) -> DataFrame:
    gt = F.col("gt")
    alleles, phasing = fields.genotype_alleles(gt), fields.genotype_phasing(gt)
    return variants(spark, d).select(
        "pos", "gt", F.array_join(F.transform(alleles, lambda a: a.cast("string")), ",", "-").alias("alleles"), F.get(phasing, F.lit(0)).alias("first_phased"),
        (F.size(phasing) > 1).__and__(F.coalesce(F.get(phasing, F.lit(1)), F.lit(False))).alias("any_bar"),
    )


@query("prj20_packed_genotypes", V + r"""SELECT pos, gt, len(regexp_extract_all(gt, '[|/]?([0-9]+|\.)', 1))::BIGINT AS ploidy, list_sum(list_transform(regexp_extract_all(gt, '[|/]?([0-9]+|\.)', 1), lambda x: CASE WHEN x = '.' THEN 0 ELSE x::INTEGER END))::BIGINT AS alt_count FROM variants""")
def packed_genotypes(spark: SparkSession, d: str) -> DataFrame:
    """Genotypes packed as (allele + 1) << 1 | phased and padded with an end marker, then read back."""
    gt, end = F.col("gt"), -127
    alleles, phasing = fields.genotype_alleles(gt), fields.genotype_phasing(gt)
    packed = F.transform(alleles, lambda a, i: F.shiftleft(F.coalesce(a, F.lit(-1)) + 1, 1).bitwiseOR(F.get(phasing, i).cast("int")))
    padded = F.slice(F.concat(packed, F.array(F.lit(end), F.lit(end))), 1, 2)
    rows = variants(spark, d).select("pos", "gt", padded.alias("raw"))
    values = F.filter("raw", lambda x: x != end)
    back = F.transform(values, lambda x: F.nullif(F.shiftright(x, 1), F.lit(0)) - 1)
    total = F.aggregate(back, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return rows.select("pos", "gt", F.size(back).cast("bigint").alias("ploidy"), total.cast("bigint").alias("alt_count"))


@query("agg23_variant_end", V + f"SELECT chrom, pos, ref, {END_SQL} AS end_ FROM variants")
def variant_end(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).select("chrom", "pos", "ref", fields.variant_end(F.col("pos"), F.col("ref"), F.col("info")).alias("end_"))


@query("agg23_variant_end_45", V + r"""SELECT chrom, pos, pos + greatest(length(ref), list_max(list_transform(string_split(nullif(regexp_extract(info, '(?:^|;)SVLEN=([^;]*)', 1), ''), ','), lambda x: nullif(x, '.')::BIGINT)), nullif(sample_dp, '.')::BIGINT) - 1 AS end_ FROM variants""")
def variant_end_45(spark: SparkSession, d: str) -> DataFrame:
    length = fields.missing(F.col("sample_dp")).cast("bigint")
    return variants(spark, d).select("chrom", "pos", fields.variant_end(F.col("pos"), F.col("ref"), F.col("info"), False, length).alias("end_"))


@query("flt05_qry04_qry05_variant_region", V + f"SELECT chrom, pos, ref, info FROM variants WHERE chrom = 'chr7' AND pos <= 2200 AND {END_SQL} >= 2000")
def region(spark: SparkSession, d: str) -> DataFrame:
    end = fields.variant_end(F.col("pos"), F.col("ref"), F.col("info"))
    return variants(spark, d).where((F.col("chrom") == "chr7") & (F.col("pos") <= 2200)).where(end >= 2000).select("chrom", "pos", "ref", "info")


@query("snk04_fn20_reduced_reference", V + "SELECT pos, translate(concat(ref, 'WMRDHVSYBKn'), 'WMRDHVSYBK', 'AAAAAACCCG') AS ref FROM variants")
def reduced_reference(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).select("pos", records.reduce_bases(F.concat("ref", F.lit("WMRDHVSYBKn"))).alias("ref"))


@query("prj32_extract", V + "SELECT concat_ws(' ', chrom, pos, ref, alt, 'sample=' || gt) AS line FROM variants")
def extract(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).select(F.concat_ws(" ", "chrom", "pos", "ref", "alt", F.concat(F.lit("sample="), F.col("gt"))).alias("line"))


@query("fn24_snk04_vcf_lines", V + "SELECT concat_ws(chr(9), chrom, pos, id, ref, alt, qual, filter, info, 'GT', gt) AS line FROM variants")
def vcf_lines(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).select(vcf_line().alias("line"))


def vcf_line():
    return F.concat_ws("\t", "chrom", "pos", "id", records.reduce_bases(F.col("ref")), "alt", "qual", "filter", "info", F.lit("GT"), "gt")


@query("jn06_prj21_dictionary", V + """, d AS (SELECT * FROM (VALUES (0, 'PASS'), (1, 'q10'), (4, 's50')) t(idx, filter_name)),
x AS (SELECT unnest(string_split(filter, ';')) AS f FROM variants WHERE filter <> '.') SELECT idx, filter_name, count(*) AS n FROM x JOIN d ON f = filter_name GROUP BY 1, 2""")
def dictionary(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.bcf import string_map

    header = ['##FILTER=<ID=q10,Description="Quality below 10">', '##FILTER=<ID=s50,Description="Half",IDX=4>']
    table = small_side(spark.createDataFrame([(i, n) for n, i in string_map(header).items()], "idx int, filter_name string"))
    # to ids, as records hold them, and back to names
    as_ids = variants(spark, d).select(F.explode(fields.listed(F.col("filter"), ";")).alias("filter_name")).join(table, "filter_name").select("idx")
    return as_ids.join(table, "idx").groupBy("idx", "filter_name").agg(F.count("*").alias("n"))


@query("agg12_variant_index", V + f""", x AS (SELECT chrom, pos, {END_SQL} AS e FROM variants), y AS (SELECT *, CASE WHEN (pos-1)>>14 = (e-1)>>14 THEN 4681 + ((pos-1)>>14) ELSE 585 + ((pos-1)>>17) END AS bin FROM x)
SELECT chrom, bin::INTEGER AS bin, count(*) AS records, min(pos) AS first_pos, max(e) AS last_pos FROM y GROUP BY 1, 2""")
def variant_index(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import coords

    end = fields.variant_end(F.col("pos"), F.col("ref"), F.col("info"))
    rows = variants(spark, d).select("chrom", "pos", end.alias("e"))
    # an END before the start is as wide as its start
    return rows.withColumn("bin", coords.bin_of(F.col("pos"), F.col("e"))).groupBy("chrom", "bin").agg(F.count("*").alias("records"), F.min("pos").alias("first_pos"), F.max("e").alias("last_pos"))
