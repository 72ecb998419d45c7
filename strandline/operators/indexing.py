"""Binning indexes, interval joins and coalescing, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coords

WINDOW_SHIFT = 14
#: Width of the tiles that ordered operators work in: what passes from a tile to the next is carried, so no task holds a whole key.
TILE = 1 << 20
#: Compressed bytes that a bin spans at least, if it isn't to be folded into its parent.
LEAST_BIN_BYTES = 1 << 16
#: Width of the buckets that interval joins meet in.
BUCKET = 1 << 14


def bin_index(records: DataFrame) -> DataFrame:
    """Per (ref_id, bin): records, first and last offset. ``records`` has ref_id, pos, aend, begin, end (offsets)."""
    binned = records.where("ref_id is not null and pos is not null").withColumn("bin", coords.bin_of(F.col("pos"), F.col("aend")))
    return binned.groupBy("ref_id", "bin").agg(F.count("*").alias("records"), F.min("begin").alias("first_offset"), F.max("end").alias("last_offset"))


def bin_chunks(records: DataFrame, keys: tuple[str, ...] = ("ref_id",), min_shift: int = coords.MIN_SHIFT, depth: int = coords.DEPTH, tile: int = TILE) -> DataFrame:
    """Per key and bin its chunks: offset ranges of consecutive records, merged where they touch."""
    binned = records.where("ref_id is not null and pos is not null").withColumn("bin", coords.bin_of(F.col("pos"), F.col("aend"), min_shift, depth))
    return coalesce_intervals(binned.select(*keys, "bin", "begin", "end"), [*keys, "bin"], "begin", "end", tile=tile)


def folded_bins(chunks: DataFrame, keys: tuple[str, ...] = ("ref_id",), depth: int = coords.DEPTH, least: int = LEAST_BIN_BYTES, tile: int = TILE) -> DataFrame:
    """Chunks with those of bins that span fewer than ``least`` compressed bytes in the parent bin, if there is one, from the deepest level up.

    ``begin`` and ``end`` are virtual offsets. Where a bin goes is worked out on
    one row a bin, which says how far it spans; chunks are joined with it once.
    """
    rows = chunks.select(*keys, "bin", "begin", "end")
    bins = rows.groupBy(*keys, "bin").agg(coords.virtual_block(F.min("begin")).alias("first"), coords.virtual_block(F.max("end")).alias("last")).withColumn("own", F.col("bin"))
    for level in range(depth, 0, -1):
        first, above, after = coords.level_offset(level), coords.level_offset(level - 1), coords.level_offset(level + 1)
        here = (F.col("bin") >= first) & (F.col("bin") < after)
        # bins of this level meet at their parent; no other bin meets anything
        parent = F.shiftright(F.col("bin") - 1, 3)
        bins = bins.withColumn("at", F.when(here, parent).when((F.col("bin") >= above) & (F.col("bin") < first), F.col("bin")).otherwise(-1 - F.col("bin")))
        same, families = Window.partitionBy(*keys, "bin"), Window.partitionBy(*keys, "at")
        span = F.max("last").over(same) - F.min("first").over(same)
        bins = bins.withColumn("span", span).withColumn("headed", F.max(F.col("bin") == F.col("at")).over(families))
        bins = bins.withColumn("bin", F.when(here & F.col("headed") & (F.col("span") < least), F.col("at")).otherwise(F.col("bin"))).drop("at", "span", "headed")
    moved = bins.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("own").alias("__own"), F.col("bin").alias("__bin"))
    same = [rows[k].eqNullSafe(moved[f"__{k}"]) for k in keys] + [rows["bin"] == moved["__own"]]
    rows = rows.join(moved, same).select(*[rows[k] for k in keys], F.col("__bin").alias("bin"), "begin", "end")
    return coalesce_intervals(rows, [*keys, "bin"], "begin", "end", tile=tile)


def reference_stats(records: DataFrame, keys: tuple[str, ...] = ("ref_id",)) -> DataFrame:
    """Per reference mapped and unmapped records and the range of offsets; the null reference counts the unplaced."""
    return records.groupBy(*keys).agg(
        F.count_if(~F.col("unmapped")).alias("mapped"), F.count_if("unmapped").alias("unmapped"), F.min("begin").alias("first_offset"), F.max("end").alias("last_offset")
    )


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Chunks of each bin numbered from 1 in their order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def linear_index(records: DataFrame, keys: tuple[str, ...] = ("ref_id",)) -> DataFrame:
    """Smallest offset of the records that reach into each 16 kb window; (ref_id, window, offset)."""
    first, last = F.shiftright(F.col("pos") - 1, WINDOW_SHIFT), F.shiftright(F.col("aend") - 1, WINDOW_SHIFT)
    reach = records.where("ref_id is not null and pos is not null").select(*keys, "begin", F.explode(F.sequence(first, last)).alias("window"))
    return reach.groupBy(*keys, "window").agg(F.min("begin").alias("offset"))


def _carried(rows: DataFrame, keys: list[str], own: Column, carry, name: str = "carried", ahead: bool = False) -> DataFrame:
    """``rows``, which have a column ``tile``, with what earlier tiles of their keys hand on (later ones, if ``ahead``).

    ``own`` is each tile's aggregate and ``carry`` combines those of the tiles
    before. Tiles are few; their window runs over them, not over rows.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("tile").desc() if ahead else "tile").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*keys, "tile").agg(own.alias("own")).withColumn(name, carry(F.col("own")).over(w))
    per = per.select(*[F.col(k).alias(f"__{k}") for k in [*keys, "tile"]], name)
    same = [rows[k].eqNullSafe(per[f"__{k}"]) for k in [*keys, "tile"]]
    joined = rows.join(per, same)
    return joined.drop(*[f"__{k}" for k in [*keys, "tile"]])


def coalesce_intervals(rows: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, tile: int = TILE) -> DataFrame:
    """Intervals merged where one starts at or before the end so far, plus ``gap``; with the number merged.

    An island is named by its first interval. A tile's first intervals may
    belong to an island that began in an earlier tile.
    """
    tiled = rows.select(*keys, F.col(start), F.col(end), F.floor(F.col(start) / tile).alias("tile"))
    reach = _carried(tiled, keys, F.max(end), F.max)
    w = Window.partitionBy(*keys, "tile").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest(F.max(end).over(w), F.col("carried"))
    marked = reach.withColumn("first", F.when(F.coalesce(F.col(start) > before + gap, F.lit(True)), F.struct(F.col(start).alias("s"), F.col(end).alias("e"))))
    upto = Window.partitionBy(*keys, "tile").orderBy(start, end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = marked.withColumn("island", F.last("first", ignorenulls=True).over(upto)).groupBy(*keys, "tile", "island")
    part = part.agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))
    part = _carried(part, keys, F.max("island"), F.max).withColumn("island", F.coalesce("island", "carried"))
    return part.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("merged")).drop("island")


def interval_join(left: DataFrame, right: DataFrame, on: tuple[str, str], left_cols: tuple[str, str], right_cols: tuple[str, str], bucket: int = BUCKET) -> DataFrame:
    """Pairs of intervals on the same reference that meet, by an equi-join on buckets.

    A pair that shares several buckets counts in the first one alone: the greater of the two first buckets.
    """
    put = lambda df, s, e: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket))))
    (ls, le), (rs, re) = left_cols, right_cols
    a, b = put(left.where(F.col(ls) <= F.col(le)), ls, le), put(right.where(F.col(rs) <= F.col(re)), rs, re)
    meets = coords.intersects(F.col(ls), F.col(le), F.col(rs), F.col(re))
    first = F.greatest(F.floor(F.col(ls) / bucket), F.floor(F.col(rs) / bucket))
    cond = (F.col(on[0]) == F.col(on[1])) & (a["bucket"] == b["bucket"]) & meets & (a["bucket"] == first)
    return a.join(b, cond).drop("bucket")


def running_offsets(rows: DataFrame, key: str, order: str, length: Column, tile: int = TILE) -> DataFrame:
    """Offset of each row within its key: the lengths before it."""
    tiled = rows.withColumn("tile", F.floor(F.col(order) / tile)).withColumn("length", length)
    tiled = _carried(tiled, [key], F.sum("length"), F.sum)
    w = Window.partitionBy(key, "tile").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(w), F.lit(0)) + F.coalesce("carried", F.lit(0))
    return tiled.withColumn("offset", offset.cast("bigint")).drop("tile", "length", "carried")


def tiles_exactly(rows: DataFrame, key: str, start: str, end: str, tile: int = TILE) -> DataFrame:
    """Per key whether each row ends where the next one starts."""
    tiled = rows.select(key, start, end, F.floor(F.col(start) / tile).alias("tile"))
    # the nearest later tile's first start: the smallest of all that come
    tiled = _carried(tiled, [key], F.min(start), F.min, ahead=True)
    w = Window.partitionBy(key, "tile").orderBy(start, end)
    ok = F.coalesce(F.coalesce(F.lead(start).over(w), "carried") == F.col(end), F.lit(True))
    return tiled.withColumn("ok", ok).groupBy(key).agg(F.bool_and("ok").alias("tiles"), F.count("*").alias("n"))


def floor_lookup(points: DataFrame, table: DataFrame, key: str, at: str, bound: str, value: str, tile: int = TILE) -> DataFrame:
    """For each point the value at the last bound not beyond it, by one pass over both sorted together."""
    both = table.select(key, F.col(bound).alias("at"), F.col(value).alias("v"), F.lit(None).cast(points.schema[at].dataType).alias("point"))
    both = both.unionByName(points.select(key, F.col(at).alias("at"), F.lit(None).cast(table.schema[value].dataType).alias("v"), F.col(at).alias("point")))
    both = both.withColumn("tile", F.floor(F.col("at") / tile))
    latest = F.max(F.when(F.col("point").isNull() & F.col("v").isNotNull(), F.struct("at", "v")))
    both = _carried(both, [key], latest, F.max)
    w = Window.partitionBy(key, "tile").orderBy("at", F.col("point").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last("v", ignorenulls=True).over(w), F.col("carried.v"))
    return both.withColumn("found", found).where("point is not null").select(key, F.col("point").alias(at), F.col("found").alias(value))


def sorted_by_file(records: DataFrame, file: str, order: str, ref: str, pos: str, tile: int = TILE) -> DataFrame:
    """Per file whether its records, in the order they stand in it, are sorted by reference and position, unplaced ones last.

    ``order`` is a record's place in the file.
    """
    key = F.struct(F.col(ref).isNull().alias("unplaced"), F.col(ref).alias("ref"), F.coalesce(pos, F.lit(0)).alias("pos"))
    tiled = records.select(file, F.col(order).alias("place"), key.alias("k"), F.floor(F.col(order) / tile).alias("tile"))
    # the greatest key so far: a sorted file never falls below it
    tiled = _carried(tiled, [file], F.max("k"), F.max)
    w = Window.partitionBy(file, "tile").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ok = F.coalesce(F.greatest(F.max("k").over(w), F.col("carried")) <= F.col("k"), F.lit(True))
    return tiled.withColumn("ok", ok).groupBy(file).agg(F.bool_and("ok").alias("sorted"))


def program_leaves(programs: DataFrame) -> DataFrame:
    """Programs that no other one names as its predecessor."""
    named = programs.select(F.col("pp").alias("id"))
    return programs.join(named, "id", "left_anti")


def program_roots(programs: DataFrame) -> DataFrame:
    return programs.where("pp is null")
