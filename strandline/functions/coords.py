"""Positions, intervals, regions, bins and virtual positions. Positions are 1-based, intervals closed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_POSITION = (1 << 63) - 1
MIN_SHIFT = 14
DEPTH = 5


@dataclass(frozen=True)
class Region:
    """A reference name with an interval; None leaves a side open."""

    name: str
    start: int | None = None
    end: int | None = None

    def __str__(self) -> str:
        if self.start is None and self.end is None:
            return self.name
        if self.end is None:
            return f"{self.name}:{self.start}"
        return f"{self.name}:{self.start or 1}-{self.end}"


def parse_position(s: str) -> int:
    if not (s.isascii() and s.isdigit()) or int(s) == 0:
        raise ValueError(f"invalid position: {s!r}")
    return int(s)


def parse_region(s: str) -> Region:
    """``name[:start[-end]]``, split at the last colon; a name with colons needs an explicit suffix."""
    if not s:
        raise ValueError("empty region")
    name, colon, interval = s.rpartition(":")
    if not colon:
        return Region(s)
    if not interval:
        return Region(name)
    start, dash, end = interval.partition("-")
    return Region(name, parse_position(start), parse_position(end) if dash else None)


def contains(position: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Whether a position lies in an interval with open sides where a bound is missing."""
    start = F.lit(1) if start is None else F.coalesce(start, F.lit(1))
    end = F.lit(MAX_POSITION) if end is None else F.coalesce(end, F.lit(MAX_POSITION))
    return position.between(start, end)


def intersects(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def in_region(region: Region, name: Column, start: Column, end: Column) -> Column:
    """Whether a row meets a region; false where its name or start is missing."""
    meets = name == region.name
    if region.end is not None:
        meets &= start <= region.end
    if region.start is not None:
        meets &= end >= region.start
    return F.coalesce(meets & start.isNotNull(), F.lit(False))


def region_text(name: Column, start: Column, end: Column) -> Column:
    return (
        F.when(start.isNull() & end.isNull(), name)
        .when(end.isNull(), F.concat(name, F.lit(":"), start))
        .otherwise(F.concat(name, F.lit(":"), F.coalesce(start, F.lit(1)), F.lit("-"), end))
    )


def to_half_open(start: Column) -> Column:
    """The 0-based start of a closed interval; its end stays."""
    return start - 1


def position(value: Column) -> Column:
    """0 means no position."""
    return F.nullif(value, F.lit(0))


def max_position(min_shift: int = MIN_SHIFT, depth: int = DEPTH) -> int:
    return (1 << (min_shift + 3 * depth)) - 1


def level_offset(level: int) -> int:
    """The first bin of a level."""
    return ((1 << 3 * level) - 1) // 7


def bin_of(start: Column, end: Column, min_shift: int = MIN_SHIFT, depth: int = DEPTH) -> Column:
    """The smallest bin that holds a closed interval."""
    found = None
    for level in range(depth, 0, -1):
        shift = min_shift + 3 * (depth - level)
        first, last = F.shiftright(start - 1, shift), F.shiftright(end - 1, shift)
        value = (first + level_offset(level)).cast("int")
        found = F.when(first == last, value) if found is None else found.when(first == last, value)
    return F.lit(0) if found is None else F.when(start.isNull() | end.isNull(), None).otherwise(found.otherwise(0))


def bins_of(start: Column, end: Column, min_shift: int = MIN_SHIFT, depth: int = DEPTH) -> Column:
    """All bins that may hold intervals meeting a closed interval, as an array."""
    levels = []
    for level in range(depth + 1):
        shift, offset = min_shift + 3 * (depth - level), level_offset(level)
        levels.append(F.sequence((F.shiftright(start - 1, shift) + offset).cast("int"), (F.shiftright(end - 1, shift) + offset).cast("int")))
    return F.concat(*levels)


def region_bins(region: Region, min_shift: int = MIN_SHIFT, depth: int = DEPTH) -> list[int]:
    """The bins of one region, for pruning; an error for positions that the index can't hold."""
    most = max_position(min_shift, depth)
    if max(region.start or 1, region.end or 1) > most:
        raise ValueError(f"positions end at {most}")
    start, end = (region.start or 1) - 1, (region.end or most) - 1
    if start > end:
        return []
    out = []
    for level in range(depth + 1):
        shift, offset = min_shift + 3 * (depth - level), level_offset(level)
        out += range((start >> shift) + offset, (end >> shift) + offset + 1)
    return out


def pack_virtual(compressed: Column, uncompressed: Column) -> Column:
    return F.shiftleft(compressed.cast("bigint"), 16).bitwiseOR(uncompressed.cast("bigint"))


def virtual_block(v: Column) -> Column:
    return F.shiftrightunsigned(v, 16)


def virtual_within(v: Column) -> Column:
    return v.bitwiseAND(F.lit(0xFFFF).cast("bigint"))
