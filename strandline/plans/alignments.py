"""Queries over alignment records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords, records
from ..functions.coords import Region, parse_region
from ..operators import alignment as ops
from ..operators import indexing
from ..operators.joins import small_side
from .registry import query
from .views import READ_LENGTH_SQL, SPAN_SQL, VIEWS, references, sql, view

A = sql("alignments")
AR = sql("alignments", "refs")
REGION = parse_region("sq2:1000-1200")
#: Aligned spans, for oracles: 1 where a CIGAR covers nothing.
AEND = f"pos + greatest({SPAN_SQL}, 1) - 1"


#: For oracles: alignments with made-up offsets, 64 bytes a record.
_COLUMNS = ", ".join(f"{VIEWS['alignments'][1][c]} AS {c}" for c in ("ref_id", "pos", "cigar", "flags"))
_X = f"x AS (SELECT *, {AEND} AS aend FROM (SELECT l_orderkey * 64 AS b, l_orderkey * 64 + 64 AS e, {_COLUMNS} FROM lineitem))"


def alignments(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "alignments")


@query("agg04_flagstat", A + """
SELECT (flags & 512) <> 0 AS qc_fail, count(*) AS total,
 count(*) FILTER (flags & 2304 = 0) AS primary_reads, count(*) FILTER (flags & 256 <> 0) AS secondary,
 count(*) FILTER (flags & 2304 = 2048) AS supplementary, count(*) FILTER (flags & 1024 <> 0) AS duplicates,
 count(*) FILTER (flags & 3328 = 1024) AS primary_duplicates, count(*) FILTER (flags & 4 = 0) AS mapped,
 count(*) FILTER (flags & 2308 = 0) AS primary_mapped, count(*) FILTER (flags & 2305 = 1) AS paired,
 count(*) FILTER (flags & 2369 = 65) AS read_1, count(*) FILTER (flags & 2433 = 129) AS read_2,
 count(*) FILTER (flags & 2311 = 3) AS proper_pair, count(*) FILTER (flags & 2317 = 1) AS mate_mapped,
 count(*) FILTER (flags & 2317 = 9) AS singletons,
 count(*) FILTER (flags & 2317 = 1 AND mate_ref_id IS DISTINCT FROM ref_id) AS mate_on_other,
 count(*) FILTER (flags & 2317 = 1 AND mate_ref_id IS DISTINCT FROM ref_id AND (mapq IS NULL OR mapq >= 5)) AS mate_on_other_hq
FROM alignments GROUP BY 1""")
def flagstat(spark: SparkSession, d: str) -> DataFrame:
    return ops.flagstat(alignments(spark, d))


@query("agg04_fn16_flagstat_percentages", A + """, s AS (
SELECT (flags & 512) <> 0 AS qc_fail, count(*) AS total, count(*) FILTER (flags & 4 = 0) AS mapped,
 count(*) FILTER (flags & 2304 = 0) AS primary_reads, count(*) FILTER (flags & 2308 = 0) AS primary_mapped,
 count(*) FILTER (flags & 2305 = 1) AS paired, count(*) FILTER (flags & 2311 = 3) AS proper_pair,
 count(*) FILTER (flags & 2317 = 9) AS singletons FROM alignments GROUP BY 1)
SELECT qc_fail, CASE WHEN total = 0 THEN 'N/A' ELSE printf('%.2f%%', mapped::DOUBLE / total * 100) END AS mapped_pct,
 CASE WHEN primary_reads = 0 THEN 'N/A' ELSE printf('%.2f%%', primary_mapped::DOUBLE / primary_reads * 100) END AS primary_mapped_pct,
 CASE WHEN paired = 0 THEN 'N/A' ELSE printf('%.2f%%', proper_pair::DOUBLE / paired * 100) END AS proper_pair_pct,
 CASE WHEN paired = 0 THEN 'N/A' ELSE printf('%.2f%%', singletons::DOUBLE / paired * 100) END AS singletons_pct FROM s""")
def flagstat_percentages(spark: SparkSession, d: str) -> DataFrame:
    return ops.flagstat_percentages(ops.flagstat(alignments(spark, d)))


@query("agg05_jn04_idxstats", AR + """, c AS (
SELECT ref_id, count(*) FILTER (flags & 4 = 0) AS mapped, count(*) FILTER (flags & 4 <> 0) AS unmapped, count(*) AS n FROM alignments GROUP BY 1)
SELECT ref_name, ref_length, coalesce(mapped, 0) AS mapped, coalesce(unmapped, 0) AS unmapped FROM refs LEFT JOIN c USING (ref_id)
UNION ALL SELECT '*', 0, 0, (SELECT coalesce(sum(n), 0)::BIGINT FROM c WHERE ref_id IS NULL)""")
def idxstats(spark: SparkSession, d: str) -> DataFrame:
    return ops.idxstats(alignments(spark, d), references(spark))


@query("agg01_count_alignments", A + "SELECT count(*) AS n FROM alignments")
def count_alignments(spark: SparkSession, d: str) -> DataFrame:
    return alignments(spark, d).agg(F.count("*").alias("n"))


@query("agg08_agg09_fn07_cigar_lengths", A + f"""
SELECT name, flags, cigar, nullif({SPAN_SQL}, 0) AS span, {READ_LENGTH_SQL} AS read_length, {AEND} AS aend FROM alignments""")
def cigar_lengths(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cigar")
    return alignments(spark, d).select("name", "flags", "cigar", records.alignment_span(c).alias("span"), records.read_length(c).alias("read_length"), records.alignment_end(F.col("pos"), c).alias("aend"))


@query("agg07_depth", A + f""", r AS (
SELECT row_number() OVER () AS id, ref_id, pos, cigar, {AEND} AS aend FROM alignments WHERE flags & 1796 = 0 AND pos IS NOT NULL AND ref_id IS NOT NULL
), o AS (SELECT id, ref_id, pos, unnest(regexp_extract_all(cigar, '(\\d+)[MIDNSHP=X]', 1))::BIGINT AS len,
 unnest(regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 2)) AS op, generate_subscripts(regexp_extract_all(cigar, '(\\d+)[MIDNSHP=X]', 1), 1) AS k FROM r
), p AS (SELECT *, pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len END) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM o
), b AS (SELECT ref_id, unnest(generate_series(s::BIGINT, (s + len - 1)::BIGINT)) AS position, 1 AS w FROM p WHERE op IN ('M', '=', 'X') AND len > 0
 UNION ALL SELECT ref_id, unnest(generate_series(pos::BIGINT, aend::BIGINT)), 0 FROM r)
SELECT ref_id, position, sum(w)::BIGINT AS depth FROM b GROUP BY 1, 2""")
def depth(spark: SparkSession, d: str) -> DataFrame:
    return ops.depth(alignments(spark, d))


@query("win02_depth_runs", A + f""", r AS (
SELECT row_number() OVER () AS id, ref_id, pos, cigar FROM alignments WHERE flags & 1796 = 0 AND pos IS NOT NULL AND ref_id IS NOT NULL
), o AS (SELECT id, ref_id, pos, unnest(regexp_extract_all(cigar, '(\\d+)[MIDNSHP=X]', 1))::BIGINT AS len,
 unnest(regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 2)) AS op, generate_subscripts(regexp_extract_all(cigar, '(\\d+)[MIDNSHP=X]', 1), 1) AS k FROM r
), p AS (SELECT *, pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len END) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM o
), b AS (SELECT ref_id, unnest(generate_series(s::BIGINT, (s + len - 1)::BIGINT)) AS position FROM p WHERE op IN ('M', '=', 'X') AND len > 0
), c AS (SELECT ref_id, position, count(*) AS depth FROM b GROUP BY 1, 2)
SELECT ref_id, depth, count(*) AS bases FROM c GROUP BY 1, 2""")
def depth_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = ops.depth_runs(alignments(spark, d))
    return runs.groupBy("ref_id", F.col("depth").cast("bigint").alias("depth")).agg(F.sum(F.col("end") - F.col("start") + 1).cast("bigint").alias("bases"))


@query("flt07_flag_predicates", A + "SELECT flag, count(*) FILTER (flags & bit <> 0) AS n FROM alignments, (VALUES " + ", ".join(f"('{n}', {b})" for n, b in records.FLAGS.items()) + ") v(flag, bit) GROUP BY flag")
def flag_predicates(spark: SparkSession, d: str) -> DataFrame:
    counted = alignments(spark, d).agg(*[F.count_if(records.has(F.col("flags"), n)).cast("bigint").alias(n) for n in records.FLAGS])
    return counted.unpivot([], list(records.FLAGS), "flag", "n")


@query("flt08_depth_filter", A + "SELECT name, flags, ref_id, pos FROM alignments WHERE flags & 1796 = 0 AND ref_id IS NOT NULL AND pos IS NOT NULL")
def depth_filter(spark: SparkSession, d: str) -> DataFrame:
    return ops.depth_reads(alignments(spark, d)).select("name", "flags", "ref_id", "pos")


@query("flt09_primary_only", A + "SELECT name, flags FROM alignments WHERE flags & 2304 = 0")
def primary_only(spark: SparkSession, d: str) -> DataFrame:
    return ops.primary_only(alignments(spark, d)).select("name", "flags")


@query("flt10_unique_by_tag", A + "SELECT name, nh FROM alignments WHERE nh = 1")
def unique_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return ops.unique_only(alignments(spark, d)).select("name", "nh")


@query("flt11_unmapped", A + "SELECT name, flags, ref_id FROM alignments WHERE flags & 4 <> 0")
def unmapped(spark: SparkSession, d: str) -> DataFrame:
    return ops.unmapped_reads(alignments(spark, d)).select("name", "flags", "ref_id")


@query("flt01_interval_contains", A + "SELECT count(*) FILTER (pos BETWEEN 1000 AND 2000) AS closed, count(*) FILTER (pos >= 1000) AS from_start, count(*) FILTER (pos <= 2000) AS to_end, count(pos) AS everywhere FROM alignments")
def interval_contains(spark: SparkSession, d: str) -> DataFrame:
    p, n = F.col("pos"), lambda c: F.count_if(c).cast("bigint")
    return alignments(spark, d).agg(
        n(coords.contains(p, F.lit(1000), F.lit(2000))).alias("closed"), n(coords.contains(p, F.lit(1000))).alias("from_start"),
        n(coords.contains(p, None, F.lit(2000))).alias("to_end"), n(coords.contains(p)).alias("everywhere"),
    )


@query("flt02_interval_intersects", A + f", x AS (SELECT *, {AEND} AS aend FROM alignments) SELECT ref_id, count(*) AS n FROM x WHERE pos <= 1200 AND aend >= 1000 GROUP BY 1")
def interval_intersects(spark: SparkSession, d: str) -> DataFrame:
    end = records.alignment_end(F.col("pos"), F.col("cigar"))
    return alignments(spark, d).where(coords.intersects(F.col("pos"), end, F.lit(1000), F.lit(1200))).groupBy("ref_id").agg(F.count("*").alias("n"))


@query("flt03_fn14_region_text", "SELECT * FROM (VALUES ('sq2', 'sq2', NULL::BIGINT, NULL::BIGINT, 'sq2'), ('sq2:5', 'sq2', 5, NULL, 'sq2:5'), ('sq2:5-9', 'sq2', 5, 9, 'sq2:5-9'), ('a:b:7', 'a:b', 7, NULL, 'a:b:7'), ('sq2:', 'sq2', NULL, NULL, 'sq2'), ('sq2:9-5', 'sq2', 9, 5, 'sq2:9-5')) t(input, name, start_, end_, text)")
def region_text(spark: SparkSession, d: str) -> DataFrame:
    given = ["sq2", "sq2:5", "sq2:5-9", "a:b:7", "sq2:", "sq2:9-5"]
    rows = [(s, r.name, r.start, r.end) for s in given for r in [parse_region(s)]]
    df = spark.createDataFrame(rows, "input string, name string, start_ bigint, end_ bigint")
    return df.withColumn("text", coords.region_text(F.col("name"), F.col("start_"), F.col("end_")))


@query("flt04_qry01_qry02_region_query", A + f", x AS (SELECT *, {AEND} AS aend FROM alignments) SELECT name, flags, pos, cigar FROM x WHERE ref_id = 2 AND pos <= 1200 AND aend >= 1000")
def region_query(spark: SparkSession, d: str) -> DataFrame:
    return ops.region_query(alignments(spark, d), REGION, references(spark)).select("name", "flags", "pos", "cigar")


@query("qry09_qry10_binned_region_query", A + f", x AS (SELECT *, {AEND} AS aend FROM alignments) SELECT name, pos, aend FROM x WHERE ref_id = 2 AND pos <= 1200 AND aend >= 1000")
def binned_region_query(spark: SparkSession, d: str) -> DataFrame:
    return ops.binned_query(ops.with_bin(alignments(spark, d)), 2, Region("sq2", 1000, 1200)).select("name", "pos", "aend")


@query("jn01_name_semi_join", A + "SELECT name, flags FROM alignments WHERE name IN (SELECT concat('r', cast(o_orderkey AS string)) FROM orders WHERE o_orderpriority LIKE '1%')")
def name_semi_join(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").where(F.col("o_orderpriority").startswith("1"))
    return ops.named(alignments(spark, d), orders.select(F.concat(F.lit("r"), F.col("o_orderkey")).alias("name"))).select("name", "flags")


@query("jn02_jn03_reference_lookup", AR + """
SELECT a.name, a.pos, r.ref_name, r.ref_length, m.ref_name AS mate_ref_name FROM alignments a
LEFT JOIN refs r ON a.ref_id = r.ref_id LEFT JOIN refs m ON a.mate_ref_id = m.ref_id""")
def reference_lookup(spark: SparkSession, d: str) -> DataFrame:
    return ops.with_references(alignments(spark, d), references(spark)).select("name", "pos", "ref_name", "ref_length", "mate_ref_name")


@query("fn22_reset", A + """, p AS (SELECT * FROM alignments WHERE flags & 2304 = 0)
SELECT name, CASE WHEN flags & 1 = 0 THEN 4 ELSE 13 + CASE WHEN flags & 64 <> 0 THEN 64 WHEN flags & 128 <> 0 THEN 128 ELSE 0 END END AS flags,
 CASE WHEN flags & 16 <> 0 THEN reverse(translate(sequence, '=ACMGRSVTWYHKDB', '=TGKCYSBAWRDMHV')) ELSE sequence END AS sequence,
 CASE WHEN flags & 16 <> 0 THEN reverse(quality) ELSE quality END AS quality FROM p""")
def reset(spark: SparkSession, d: str) -> DataFrame:
    return ops.reset(alignments(spark, d))


@query("fn23_single_segment_fastq", A + """, p AS (SELECT * FROM alignments WHERE flags & 2305 = 0)
SELECT name, CASE WHEN flags & 16 <> 0 THEN reverse(translate(sequence, 'ACMGRSVTWYHKDB', 'TGKCYSBAWRDMHV')) ELSE sequence END AS sequence,
 CASE WHEN flags & 16 <> 0 THEN reverse(quality) ELSE quality END AS quality FROM p""")
def single_segment_fastq(spark: SparkSession, d: str) -> DataFrame:
    return ops.to_fastq(alignments(spark, d).where(~records.has(F.col("flags"), "segmented")))


@query("fn24_snk01_sam_lines", AR + """
SELECT concat_ws(chr(9), a.name, a.flags, coalesce(r.ref_name, '*'), coalesce(a.pos::VARCHAR, '0'), coalesce(a.mapq::VARCHAR, '255'), a.cigar,
 CASE WHEN m.ref_name IS NULL THEN '*' WHEN m.ref_name IS NOT DISTINCT FROM r.ref_name THEN '=' ELSE m.ref_name END,
 a.mate_pos, a.tlen, a.sequence, a.quality, 'NH:i:' || a.nh, 'RG:Z:' || a.rg) AS line
FROM alignments a LEFT JOIN refs r ON a.ref_id = r.ref_id LEFT JOIN refs m ON a.mate_ref_id = m.ref_id""")
def sam_lines(spark: SparkSession, d: str) -> DataFrame:
    named = ops.with_references(alignments(spark, d), references(spark))
    return named.select(ops.sam_line(named).alias("line"))


@query("jn07_fn08_template_length", A + f""", x AS (
SELECT name, pos, {AEND} AS aend, row_number() OVER (PARTITION BY name ORDER BY flags, pos, cigar, mapq, tlen) AS k FROM alignments WHERE flags & 2309 = 1)
SELECT a.name, a.pos, b.pos AS mate_pos, CASE WHEN a.pos IS NULL OR b.pos IS NULL THEN 0
 WHEN a.pos <= b.pos THEN greatest(a.aend, b.aend) - least(a.pos, b.pos) + 1 ELSE -(greatest(a.aend, b.aend) - least(a.pos, b.pos) + 1) END AS tlen
FROM x a JOIN x b ON a.name = b.name AND b.k = CASE WHEN a.k % 2 = 1 THEN a.k + 1 ELSE a.k - 1 END""")
def template_length(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    f = F.col("flags")
    rows = alignments(spark, d).where(records.has(f, "segmented") & ~records.has(f, "unmapped", "secondary", "supplementary"))
    w = Window.partitionBy("name").orderBy("flags", "pos", "cigar", "mapq", "tlen")
    # mates are the 1st and 2nd, the 3rd and 4th... of a name: one shuffle serves both sides
    rows = rows.withColumn("aend", records.alignment_end(F.col("pos"), F.col("cigar"))).withColumn("k", F.row_number().over(w))
    odd = F.col("k") % 2 == 1
    other = lambda c: F.when(odd, F.lead(c).over(w)).otherwise(F.lag(c).over(w))
    rows = rows.select("name", "pos", "aend", other("pos").alias("mate_pos"), other("aend").alias("mate_end"), other("k").alias("mk")).where("mk is not null")
    return rows.select("name", "pos", "mate_pos", ops.template_length(F.col("pos"), F.col("aend"), F.col("mate_pos"), F.col("mate_end")).alias("tlen"))


@query("jn08_mate_links", A + """, x AS (
SELECT name, flags, pos, row_number() OVER (PARTITION BY name ORDER BY flags, pos, cigar, mapq, tlen) AS k, count(*) OVER (PARTITION BY name) AS n FROM alignments WHERE flags & 257 = 1)
SELECT name, k, CASE WHEN k < n THEN k + 1 END AS next_k FROM x""")
def mate_links(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    f = F.col("flags")
    w = Window.partitionBy("name").orderBy("flags", "pos", "cigar", "mapq", "tlen")
    rows = alignments(spark, d).where(records.has(f, "segmented") & ~records.has(f, "secondary")).withColumn("k", F.row_number().over(w).cast("bigint"))
    return rows.select("name", "k", F.lead("k").over(w).alias("next_k"))


@query("jn11_read_groups", A + "SELECT rg, count(*) AS n, dense_rank() OVER (ORDER BY rg) - 1 AS rg_id FROM alignments GROUP BY rg")
def read_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = alignments(spark, d)
    from pyspark.sql import Window

    # a header's groups, numbered in order
    groups = rows.select("rg").distinct().withColumn("rg_id", (F.row_number().over(Window.orderBy("rg")) - 1).cast("bigint"))
    joined = rows.join(small_side(groups), "rg", "left").withColumn("rg_id", F.coalesce("rg_id", F.raise_error(F.lit("unknown read group")).cast("bigint")))
    return joined.groupBy("rg", "rg_id").agg(F.count("*").alias("n")).select("rg", "n", "rg_id")


@query("set01_concatenate", A + "SELECT count(*) * 2 AS n, count(DISTINCT name) AS names FROM alignments")
def concatenate(spark: SparkSession, d: str) -> DataFrame:
    a = alignments(spark, d)
    return ops.concatenated(a, a).agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@query("set02_split_by_group", A + "SELECT rg, count(*) AS n FROM alignments WHERE rg IS NOT NULL GROUP BY rg")
def split_by_group(spark: SparkSession, d: str) -> DataFrame:
    a = alignments(spark, d)
    return ops.split_by_group(a, a.select("rg").distinct()).groupBy("rg").agg(F.count("*").alias("n"))


@query("srt01_coordinate_order", A + ", o AS (SELECT ref_id, pos, row_number() OVER (ORDER BY ref_id NULLS LAST, pos NULLS LAST) AS k FROM alignments) SELECT ref_id, min(k) AS first_row, max(k) AS last_row FROM o GROUP BY 1")
def coordinate_order(spark: SparkSession, d: str) -> DataFrame:
    # a global rank without a global window: rows before a reference are counted, not sorted
    a = alignments(spark, d)
    from pyspark.sql import Window

    counts = a.groupBy("ref_id").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.col("ref_id").asc_nulls_last())
    return counts.withColumn("last_row", F.sum("n").over(w)).select("ref_id", (F.col("last_row") - F.col("n") + 1).alias("first_row"), "last_row")


@query("prj07_fn21_cigar_ops", A + r""", o AS (SELECT unnest(regexp_extract_all(cigar, '(\d+)([MIDNSHP=X])', 2)) AS op, unnest(regexp_extract_all(cigar, '(\d+)([MIDNSHP=X])', 1))::BIGINT AS len FROM alignments)
SELECT op, count(*) AS n, sum(len)::BIGINT AS bases, op IN ('M','I','S','=','X') AS consumes_read, op IN ('M','D','N','=','X') AS consumes_reference FROM o GROUP BY op""")
def cigar_ops(spark: SparkSession, d: str) -> DataFrame:
    o = alignments(spark, d).select(F.inline(records.cigar_ops(F.col("cigar"))))
    return o.groupBy("op").agg(F.count("*").alias("n"), F.sum("len").alias("bases")).select(
        "op", "n", "bases", records.consumes_read(F.col("op")).alias("consumes_read"), records.consumes_reference(F.col("op")).alias("consumes_reference")
    )


@query("prj06_prj03_binary_core", A + """
SELECT name, coalesce(ref_id, -1) AS raw_ref_id, coalesce(pos, 0) - 1 AS raw_pos, ref_id, pos, 'MIDNSHP=X'[l_code + 1] AS op, l_len AS len
FROM (SELECT *, flags % 9 AS l_code, 1 + flags % 50 AS l_len FROM alignments)""")
def binary_core(spark: SparkSession, d: str) -> DataFrame:
    raw = alignments(spark, d).select(
        "name", F.coalesce("ref_id", F.lit(-1)).alias("raw_ref_id"), (F.coalesce("pos", F.lit(0)) - 1).alias("raw_pos"),
        F.shiftleft((F.col("flags") % 50 + 1), 4).bitwiseOR(F.col("flags") % 9).alias("raw_op"),
    )
    op = records.unpack_cigar_op(F.col("raw_op"))
    return raw.select(
        "name", "raw_ref_id", "raw_pos", F.nullif("raw_ref_id", F.lit(-1)).alias("ref_id"), F.nullif(F.col("raw_pos") + 1, F.lit(0)).alias("pos"), op["op"].alias("op"), op["len"].alias("len"),
    )


@query("prj08_long_cigar", A + """, c AS (SELECT name, cigar, length(sequence) AS n, nh FROM alignments)
SELECT name, CASE WHEN nh = 1 THEN cigar ELSE cigar END AS resolved, nh = 1 AS was_placeholder FROM c""")
def long_cigar(spark: SparkSession, d: str) -> DataFrame:
    # a placeholder <read length>S<span>N stands for a CIGAR kept in tag CG; without the tag it is an error
    rows = alignments(spark, d)
    n = F.length("sequence")
    stored = rows.select(
        "name", n.alias("l_seq"), F.when(F.col("nh") == 1, F.concat(n, F.lit("S"), F.coalesce(records.alignment_span(F.col("cigar")), F.lit(0)), F.lit("N"))).otherwise(F.col("cigar")).alias("cigar"),
        F.when(F.col("nh") == 1, F.col("cigar")).alias("cg"),
    )
    return stored.select("name", resolved_cigar(F.col("cigar"), F.col("l_seq"), F.col("cg")).alias("resolved"), F.col("cg").isNotNull().alias("was_placeholder"))


def resolved_cigar(cigar, l_seq, cg):
    placeholder = F.regexp_extract(cigar, r"^(\d+)S\d+N$", 1) == l_seq.cast("string")
    return F.when(~placeholder, cigar).when(cg.isNotNull(), cg).otherwise(F.raise_error(F.lit("long CIGAR without tag CG")))


@query("agg10_agg11_bin_index", A + ", " + _X + """,
y AS (SELECT *, CASE WHEN (pos-1)>>14 = (aend-1)>>14 THEN 4681 + ((pos-1)>>14) WHEN (pos-1)>>17 = (aend-1)>>17 THEN 585 + ((pos-1)>>17) ELSE 73 + ((pos-1)>>20) END AS bin FROM x WHERE ref_id IS NOT NULL AND pos IS NOT NULL)
SELECT ref_id, bin::INTEGER AS bin, count(*) AS records, min(b) AS first_offset, max(e) AS last_offset FROM y GROUP BY 1, 2""")
def bin_index(spark: SparkSession, d: str) -> DataFrame:
    return indexing.bin_index(_offsets(spark, d))


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    """Alignments with made-up offsets: 64 bytes a record."""
    columns = VIEWS["alignments"][1]
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(
        *[F.expr(columns[c]).alias(c) for c in ("ref_id", "pos", "cigar", "flags")], (F.col("l_orderkey") * 64).alias("begin"), (F.col("l_orderkey") * 64 + 64).alias("end")
    )
    return rows.withColumn("aend", records.alignment_end(F.col("pos"), F.col("cigar"))).withColumn("unmapped", records.has(F.col("flags"), "unmapped"))




@query("agg10_reference_stats", A + ", " + _X + " SELECT ref_id, count(*) FILTER (flags & 4 = 0) AS mapped, count(*) FILTER (flags & 4 <> 0) AS unmapped, min(b) AS first_offset, max(e) AS last_offset FROM x GROUP BY 1")
def reference_stats(spark: SparkSession, d: str) -> DataFrame:
    return indexing.reference_stats(_offsets(spark, d))


@query("agg17_bin_chunks", A + ", " + _X + """, y AS (SELECT *, CASE WHEN (pos-1)>>14 = (aend-1)>>14 THEN 4681 + ((pos-1)>>14) WHEN (pos-1)>>17 = (aend-1)>>17 THEN 585 + ((pos-1)>>17) ELSE 73 + ((pos-1)>>20) END AS bin FROM x WHERE ref_id IS NOT NULL AND pos IS NOT NULL),
m AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY ref_id, bin ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS island FROM y),
n AS (SELECT *, sum(island) OVER (PARTITION BY ref_id, bin ORDER BY b, e RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m)
SELECT ref_id, bin::INTEGER AS bin, min(b) AS "begin", max(e) AS "end", count(*) AS merged FROM n GROUP BY ref_id, bin, g""")
def bin_chunks(spark: SparkSession, d: str) -> DataFrame:
    return indexing.bin_chunks(_offsets(spark, d))


@query("win05_linear_index", A + ", " + _X + " SELECT ref_id, w AS \"window\", min(b) AS \"offset\" FROM (SELECT ref_id, b, unnest(generate_series((pos-1)>>14, (aend-1)>>14)) AS w FROM x WHERE ref_id IS NOT NULL AND pos IS NOT NULL) GROUP BY 1, 2")
def linear_index(spark: SparkSession, d: str) -> DataFrame:
    return indexing.linear_index(_offsets(spark, d))


@query("set04_bins", A + f""", x AS (SELECT ref_id, pos * 40 AS s, ({AEND}) * 41 AS e FROM alignments WHERE pos IS NOT NULL)
SELECT s, e, (CASE WHEN (s-1)>>14 = (e-1)>>14 THEN 4681 + ((s-1)>>14) WHEN (s-1)>>17 = (e-1)>>17 THEN 585 + ((s-1)>>17) WHEN (s-1)>>20 = (e-1)>>20 THEN 73 + ((s-1)>>20)
 WHEN (s-1)>>23 = (e-1)>>23 THEN 9 + ((s-1)>>23) WHEN (s-1)>>26 = (e-1)>>26 THEN 1 + ((s-1)>>26) ELSE 0 END)::INTEGER AS bin,
 (1 + 1 + ((e-1)>>26) - ((s-1)>>26) + 1 + ((e-1)>>23) - ((s-1)>>23) + 1 + ((e-1)>>20) - ((s-1)>>20) + 1 + ((e-1)>>17) - ((s-1)>>17) + 1 + ((e-1)>>14) - ((s-1)>>14))::BIGINT AS n_bins FROM x""")
def bins(spark: SparkSession, d: str) -> DataFrame:
    end = records.alignment_end(F.col("pos"), F.col("cigar"))
    rows = alignments(spark, d).where("pos is not null").select((F.col("pos") * 40).alias("s"), (end * 41).alias("e"))
    return rows.select("s", "e", coords.bin_of(F.col("s"), F.col("e")).alias("bin"), F.size(coords.bins_of(F.col("s"), F.col("e"))).cast("bigint").alias("n_bins"))


@query("prj34_virtual_positions", "SELECT l_orderkey * 977 AS compressed, l_partkey % 65536 AS within, ((l_orderkey * 977) << 16) | (l_partkey % 65536) AS virtual FROM lineitem")
def virtual_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(coords.pack_virtual(F.col("l_orderkey") * 977, F.col("l_partkey") % 65536).alias("virtual"))
    v = F.col("virtual")
    return rows.select(coords.virtual_block(v).alias("compressed"), coords.virtual_within(v).alias("within"), "virtual")


@query("fn15_fn17_fn18_positions", A + "SELECT name, pos, nullif(coalesce(pos, 0), 0) AS position, pos - 1 AS half_open_start, 536870911::BIGINT AS index_max, pos IS NULL OR pos <= 536870911 AS in_index FROM alignments")
def positions(spark: SparkSession, d: str) -> DataFrame:
    return alignments(spark, d).select(
        "name", "pos", coords.position(F.coalesce("pos", F.lit(0))).alias("position"), coords.to_half_open(F.col("pos")).alias("half_open_start"),
        F.lit(coords.max_position()).alias("index_max"), (F.col("pos").isNull() | (F.col("pos") <= coords.max_position())).alias("in_index"),
    )


@query("agg18_slice_context", A + f", x AS (SELECT *, {AEND} AS aend, l % 50 AS slice FROM (SELECT alignments.*, cast(substr(name, 2) AS BIGINT) AS l FROM alignments)) SELECT slice, sum(length(sequence))::BIGINT AS bases, CASE WHEN count(DISTINCT coalesce(ref_id, -1)) > 1 THEN 'many' WHEN count(ref_id) = 0 THEN 'none' ELSE 'single' END AS context, min(pos) AS first_pos, max(aend) AS last_pos FROM x GROUP BY slice")
def slice_context(spark: SparkSession, d: str) -> DataFrame:
    rows = alignments(spark, d).withColumn("aend", records.alignment_end(F.col("pos"), F.col("cigar"))).withColumn("slice", F.substring("name", 2, 20).cast("bigint") % 50)
    kind = F.when(F.countDistinct(F.coalesce("ref_id", F.lit(-1))) > 1, "many").when(F.count("ref_id") == 0, "none").otherwise("single")
    return rows.groupBy("slice").agg(F.sum(F.length("sequence")).cast("bigint").alias("bases"), kind.alias("context"), F.min("pos").alias("first_pos"), F.max("aend").alias("last_pos"))


@query("agg13_flt18_cram_index", A + f", x AS (SELECT *, {AEND} AS aend, cast(substr(name, 2) AS BIGINT) % 50 AS slice FROM alignments), i AS (SELECT slice, ref_id, min(pos) AS start_, max(aend) - min(pos) + 1 AS span FROM x GROUP BY 1, 2) SELECT slice, ref_id, start_, span FROM i WHERE ref_id = 2 AND start_ IS NOT NULL AND span > 0 AND start_ <= 1200 AND start_ + span - 1 >= 1000")
def cram_index(spark: SparkSession, d: str) -> DataFrame:
    rows = alignments(spark, d).withColumn("aend", records.alignment_end(F.col("pos"), F.col("cigar"))).withColumn("slice", F.substring("name", 2, 20).cast("bigint") % 50)
    index = rows.groupBy("slice", "ref_id").agg(F.min("pos").alias("start_"), (F.max("aend") - F.min("pos") + 1).alias("span"))
    return index.where("ref_id = 2 and start_ is not null and span > 0 and start_ <= 1200 and start_ + span - 1 >= 1000")
