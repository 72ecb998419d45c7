"""Filters, statistics and transforms of alignment records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coords
from ..functions.coords import Region
from ..functions.records import DEPTH_EXCLUDED, FLAGS, NOT_PRIMARY, alignment_end, has, percentage, read_reverse_complement, sequence_digest
from .joins import small_side

LEAST_HIGH_QUALITY = 5

COUNTERS = (
    "total", "primary_reads", "secondary", "supplementary", "duplicates", "primary_duplicates", "mapped", "primary_mapped",
    "paired", "read_1", "read_2", "proper_pair", "mate_mapped", "singletons", "mate_on_other", "mate_on_other_hq",
)


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def flag_counters() -> dict[str, Column]:
    """The sixteen conditions that flag statistics count."""
    f = F.col("flags")
    secondary, supplementary = has(f, "secondary"), has(f, "supplementary")
    primary = ~secondary & ~supplementary
    mapped, duplicate = ~has(f, "unmapped"), has(f, "duplicate")
    paired = primary & has(f, "segmented")
    both = paired & mapped & ~has(f, "mate_unmapped")
    other = both & ~F.col("mate_ref_id").eqNullSafe(F.col("ref_id"))
    conditions = (
        F.lit(True), primary, secondary, supplementary & ~secondary, duplicate, primary & duplicate, mapped, primary & mapped,
        paired, paired & has(f, "first_segment"), paired & has(f, "last_segment"), paired & mapped & has(f, "properly_segmented"),
        both, paired & mapped & has(f, "mate_unmapped"), other, other & (F.col("mapq").isNull() | (F.col("mapq") >= LEAST_HIGH_QUALITY)),
    )
    return dict(zip(COUNTERS, conditions, strict=True))


def flagstat(alignments: DataFrame) -> DataFrame:
    """One row for reads that pass quality control and one for those that fail, with sixteen counters."""
    return alignments.groupBy(has(F.col("flags"), "qc_fail").alias("qc_fail")).agg(*[_count(c).alias(n) for n, c in flag_counters().items()])


def flagstat_percentages(stats: DataFrame) -> DataFrame:
    """Mapped, primary mapped, properly paired and singleton shares as text."""
    shares = (("mapped", "total"), ("primary_mapped", "primary_reads"), ("proper_pair", "paired"), ("singletons", "paired"))
    return stats.select("qc_fail", *[percentage(F.col(n), F.col(d)).alias(f"{n}_pct") for n, d in shares])


def flagstat_report(stats: DataFrame) -> DataFrame:
    """One line for each counter: passed + failed."""
    side = lambda failed, n: F.coalesce(F.max(F.when(F.col("qc_fail") == failed, F.col(n))), F.lit(0))
    one = stats.agg(*[F.struct(side(False, n).alias("passed"), side(True, n).alias("failed")).alias(n) for n in COUNTERS])
    rows = F.array(*[F.struct(F.lit(i).alias("line"), F.format_string("%d + %d " + n.replace("_", " "), F.col(f"{n}.passed"), F.col(f"{n}.failed")).alias("text")) for i, n in enumerate(COUNTERS)])
    return one.select(F.inline(rows))


def idxstats(alignments: DataFrame, references: DataFrame) -> DataFrame:
    """Per reference its length and mapped and unmapped reads placed on it; '*' counts reads without a place."""
    unmapped = has(F.col("flags"), "unmapped")
    counts = alignments.groupBy("ref_id").agg(_count(~unmapped).alias("mapped"), _count(unmapped).alias("unmapped"), F.count("*").alias("n"))
    placed = references.join(counts, "ref_id", "left").select(
        "ref_name", "ref_length", F.coalesce("mapped", F.lit(0)).cast("bigint").alias("mapped"), F.coalesce("unmapped", F.lit(0)).cast("bigint").alias("unmapped")
    )
    rest = counts.where("ref_id is null").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("unmapped"))
    star = rest.select(F.lit("*").alias("ref_name"), F.lit(0).cast("bigint").alias("ref_length"), F.lit(0).cast("bigint").alias("mapped"), "unmapped")
    return placed.unionByName(star)


def region_query(alignments: DataFrame, region: Region, references: DataFrame) -> DataFrame:
    """Reads that meet a region; an error for a reference that the header doesn't have."""
    known = references.where(F.col("ref_name") == region.name).select("ref_id").first()
    if known is None:
        raise ValueError(f"unknown reference: {region.name}")
    end = alignment_end(F.col("pos"), F.col("cigar"))
    # the start bound alone reaches the scan; the end depends on the CIGAR
    rows = alignments.where(F.col("ref_id") == known["ref_id"])
    if region.end is not None:
        rows = rows.where(F.col("pos") <= region.end)
    if region.start is not None:
        rows = rows.where(end >= region.start)
    return rows.where(F.col("pos").isNotNull())


def with_bin(alignments: DataFrame) -> DataFrame:
    """With ``aend`` and ``bin``: written partitioned by (ref_id, bin), region queries read their bins' files alone."""
    aend = alignment_end(F.col("pos"), F.col("cigar"))
    return alignments.withColumn("aend", aend).withColumn("bin", coords.bin_of(F.col("pos"), F.col("aend")))


def binned_query(binned: DataFrame, ref_id: int, region: Region) -> DataFrame:
    """Region query over rows with ``bin``: bins prune, the interval decides."""
    rows = binned.where((F.col("ref_id") == ref_id) & F.col("bin").isin(coords.region_bins(region)))
    return rows.where((F.col("pos") <= (region.end or coords.max_position())) & (F.col("aend") >= (region.start or 1)))


def unmapped_reads(alignments: DataFrame) -> DataFrame:
    """Every unmapped read, placed or not."""
    return alignments.where(has(F.col("flags"), "unmapped"))


def primary_only(alignments: DataFrame) -> DataFrame:
    return alignments.where(F.col("flags").bitwiseAND(F.lit(NOT_PRIMARY)) == 0)


def unique_only(alignments: DataFrame) -> DataFrame:
    """Reads with one reported alignment (tag NH); reads without the tag are dropped."""
    return alignments.where(F.col("nh") == 1)


def named(alignments: DataFrame, names: DataFrame) -> DataFrame:
    """Reads whose name is listed; the list is deduplicated by the semi-join, and sized by the engine."""
    return alignments.join(names, "name", "left_semi")


def with_references(alignments: DataFrame, references: DataFrame) -> DataFrame:
    """Names and lengths of the read's and its mate's reference; an error for an id that the header lacks."""
    refs = small_side(references)
    mates = small_side(references.select(F.col("ref_id").alias("mate_ref_id"), F.col("ref_name").alias("mate_ref_name")))
    out = alignments.join(refs, "ref_id", "left").join(mates, "mate_ref_id", "left")
    lost = (F.col("ref_id").isNotNull() & F.col("ref_name").isNull()) | (F.col("mate_ref_id").isNotNull() & F.col("mate_ref_name").isNull())
    return out.withColumn("ref_name", F.when(lost, F.raise_error(F.lit("reference not in the header"))).otherwise(F.col("ref_name")))


def depth_reads(alignments: DataFrame) -> DataFrame:
    """Reads that count towards depth: mapped, primary or supplementary, not failed, not duplicates, placed."""
    return alignments.where((F.col("flags").bitwiseAND(F.lit(DEPTH_EXCLUDED)) == 0) & F.col("ref_id").isNotNull() & F.col("pos").isNotNull())


def _segments(cigar: Column) -> Column:
    """array<struct<off, len, w>> of the runs on the reference by their offset, in one pass over the operations.

    M, = and X weigh 1, D and N weigh 0.
    """
    from ..functions.records import cigar_ops

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<off:bigint,len:bigint,w:bigint>>").alias("found"))

    def step(state, op):
        covers = op["op"].isin("M", "=", "X")
        moves = op["op"].isin("M", "=", "X", "D", "N")
        more = F.array(F.struct(state["at"].alias("off"), op["len"].alias("len"), covers.cast("bigint").alias("w")))
        return F.struct(
            F.when(moves, state["at"] + op["len"]).otherwise(state["at"]).alias("at"),
            F.when(moves, F.concat(state["found"], more)).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(cigar_ops(cigar), start, step, lambda s: s["found"])


def depth(alignments: DataFrame, region_start: int | None = None, region_end: int | None = None) -> DataFrame:
    """Depth at every position that a read spans, 0 where reads only skip or delete; (ref_id, position, depth).

    Runs are expanded to positions with their weight, and sums combine before the shuffle; no sort is
    needed. A read whose CIGAR covers nothing counts 0 at its start.
    """
    runs = _segments(F.col("cigar"))
    nothing = F.array(F.struct(F.lit(0).cast("bigint").alias("off"), F.lit(1).cast("bigint").alias("len"), F.lit(0).cast("bigint").alias("w")))
    spanned = F.exists(runs, lambda r: r["len"] > 0)
    rows = depth_reads(alignments).select("ref_id", "pos", F.explode(F.when(spanned, runs).otherwise(nothing)).alias("r")).where("r.len > 0")
    lo, hi = F.col("pos") + F.col("r.off"), F.col("pos") + F.col("r.off") + F.col("r.len") - 1
    lo = lo if region_start is None else F.greatest(lo, F.lit(region_start))
    hi = hi if region_end is None else F.least(hi, F.lit(region_end))
    rows = rows.select("ref_id", lo.alias("lo"), hi.alias("hi"), F.col("r.w").alias("w")).where("lo <= hi")
    at = rows.select("ref_id", "w", F.explode(F.sequence("lo", "hi")).alias("position"))
    return at.groupBy("ref_id", "position").agg(F.sum("w").alias("depth"))


def depth_runs(alignments: DataFrame) -> DataFrame:
    """Depth as runs of equal value, from +1 and -1 events: rows grow with reads, not with bases.

    (ref_id, start, end, depth) for covered runs. Events are combined by position before the window,
    which runs per reference and 16 kb tile: a tile starts from the number of reads open at its edge.
    """
    from pyspark.sql import Window

    tile = 1 << 14
    reads = depth_reads(alignments).select("ref_id", "pos", F.explode(_segments(F.col("cigar"))).alias("run"))
    s, e = F.col("pos") + F.col("run.off"), F.col("pos") + F.col("run.off") + F.col("run.len")
    tiles = F.sequence(F.floor(s / tile), F.floor((e - 1) / tile))
    split = reads.where("run.len > 0 and run.w > 0").select("ref_id", s.alias("s"), e.alias("e"), F.explode(tiles).alias("tile"))
    split = split.select("ref_id", "tile", F.greatest("s", F.col("tile") * tile).alias("s"), F.least("e", (F.col("tile") + 1) * tile).alias("e"))
    events = split.select("ref_id", "tile", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("v"))
    events = events.groupBy("ref_id", "tile", F.col("v.at").alias("at")).agg(F.sum("v.d").alias("d"))
    w = Window.partitionBy("ref_id", "tile").orderBy("at")
    runs = events.withColumn("depth", F.sum("d").over(w)).withColumn("next", F.lead("at").over(w))
    return runs.where("depth > 0 and next is not null").select("ref_id", F.col("at").alias("start"), (F.col("next") - 1).alias("end"), "depth")


def reset(alignments: DataFrame) -> DataFrame:
    """Reads as they came from the machine: alignment cleared, reversed ones turned back, extra alignments dropped."""
    f = F.col("flags")
    segment = F.when(has(f, "first_segment"), FLAGS["first_segment"]).when(has(f, "last_segment"), FLAGS["last_segment"]).otherwise(0)
    flags = F.when(has(f, "segmented"), F.lit(FLAGS["unmapped"] | FLAGS["segmented"] | FLAGS["mate_unmapped"]) + segment).otherwise(FLAGS["unmapped"])
    turned = has(f, "reverse_complemented")
    return primary_only(alignments).select(
        "name",
        flags.cast("int").alias("flags"),
        F.when(turned, read_reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")).alias("sequence"),
        F.when(turned, F.reverse("quality")).otherwise(F.col("quality")).alias("quality"),
    )


def to_fastq(alignments: DataFrame) -> DataFrame:
    """Single-segment reads as (name, sequence, quality); an error for reads of more segments."""
    f = F.col("flags")
    name = F.when(has(f, "segmented"), F.raise_error(F.lit("only single-segment reads are supported"))).otherwise(F.coalesce("name", F.lit("*")))
    turned = has(f, "reverse_complemented")
    # the check comes before the filter, as in reading order
    rows = alignments.withColumn("name", name)
    return primary_only(rows).select(
        "name",
        F.when(turned, read_reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")).alias("sequence"),
        F.when(turned, F.reverse("quality")).otherwise(F.col("quality")).alias("quality"),
    )


def sam_line(with_names: DataFrame) -> Column:
    """A SAM text line of rows with reference names; the mate's is '=' where it is the read's own."""
    text = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default))
    mate = F.when(F.col("mate_ref_name").isNull(), "*").when(F.col("mate_ref_name").eqNullSafe(F.col("ref_name")), "=").otherwise(F.col("mate_ref_name"))
    tags = [F.concat(F.lit("NH:i:"), F.col("nh")), F.concat(F.lit("RG:Z:"), F.col("rg"))]
    return F.concat_ws(
        "\t", text("name", "*"), text("flags", "0"), text("ref_name", "*"), text("pos", "0"), text("mapq", "255"), text("cigar", "*"),
        mate, text("mate_pos", "0"), text("tlen", "0"), text("sequence", "*"), text("quality", "*"), *tags,
    )


def template_length(start: Column, end: Column, mate_start: Column, mate_end: Column) -> Column:
    """Signed length of a template: positive for the segment that starts first, 0 where a start is missing."""
    length = F.greatest(end, mate_end) - F.least(start, mate_start) + 1
    return F.when(start.isNull() | mate_start.isNull(), F.lit(0)).when(start <= mate_start, length).otherwise(-length)


def split_by_group(alignments: DataFrame, groups: DataFrame) -> DataFrame:
    """Reads with a read group, checked against the header's; write ``partitionBy('rg')`` to split them."""
    known = small_side(groups.select("rg", F.lit(True).alias("known")))
    rows = alignments.where(F.col("rg").isNotNull()).join(known, "rg", "left")
    return rows.withColumn("rg", F.when(F.col("known"), F.col("rg")).otherwise(F.raise_error(F.lit("unknown read group")))).drop("known")


def validated_slices(slices: DataFrame, references: DataFrame) -> DataFrame:
    """``slices`` (name, start_, span, md5, ...) with ``valid``: whether their reference's bases there have that digest.

    Null where the reference isn't there or ends before the slice does. Bases
    are cut out of a reference once for each span that slices ask for.
    """
    spans = slices.select("name", "start_", "span").distinct().join(references.select("name", "sequence"), "name", "left")
    bases = F.expr("substring(sequence, cast(start_ as int), cast(span as int))")
    whole = F.length("sequence") >= F.col("start_") + F.col("span") - 1
    spans = spans.select("name", "start_", "span", F.when(whole, sequence_digest(bases)).alias("found"))
    return slices.join(spans, ["name", "start_", "span"], "left").withColumn("valid", F.col("md5") == F.col("found")).drop("found")


def concatenated(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_coordinate_order(alignments: DataFrame) -> DataFrame:
    return alignments.orderBy(F.col("ref_id").asc_nulls_last(), F.col("pos").asc_nulls_last())
