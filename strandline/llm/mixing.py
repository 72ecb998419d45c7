"""Mixing sources to target weights by Pareto order sampling (operator 8).

Every source gets a target of words. Within a source the copies that a
document is due grow with its length, by ``weight``, up to ``most`` of them, at
the one rate that makes the words due the target. Its whole copies are
certain. What is left is its inclusion probability: documents are ranked by
random odds over inclusion odds, and the first of them are taken once more, up
to the point where the words taken come nearest to the target.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Staging, small_side

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix in percent of all words, and the most times that a source is taken.
SHARE_PERCENT = 150
MOST = 2
#: Ranges that the order statistic, which lies between 0 and 1, is counted in before rows are ranked.
RANGES = 4096


def n_words(text: Column) -> Column:
    """Runs of characters other than space and \\t to \\r; 0 for null."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(spaced, " "), "")).cast("bigint"), F.lit(0).cast("bigint"))


def draw(key: Column, text: Column, seed: str) -> Column:
    """A number between 0 and 1, exclusive, from the key's hash (from the text's where the key is null): reruns agree."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.md5(text.cast("binary")), F.lit("")))
    bits = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def weight(size: Column) -> Column:
    """Copies due grow with this: one and the whole square root of the size. Whole numbers, so sums are exact in any order."""
    return (F.floor(F.sqrt(size.cast("double"))) + 1).cast("bigint")


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """Per source its size and its target of words.

    Weights go to the sources by code point, null last. No target exceeds
    ``most`` times its source; what would be above goes to the others by
    weight. The common level of words for a weight is found in one sweep over
    the sources by the words for a weight that they could hold: capping the
    first k leaves a level that rises with k just until no more are capped.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    t = t.withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("used", F.coalesce(F.sum("w").over(before), F.lit(0)))
    words = F.sum("source_size").over(whole).cast("double") * share / 100
    level = (words - F.col("capped")) / (F.sum("w").over(whole) - F.col("used"))
    t = t.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return t.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def rates(sized: DataFrame, t: DataFrame, most: int = MOST) -> DataFrame:
    """``t`` with ``rate``: copies due for a unit of weight, such that min(``most``, rate x weight) x size sums to the target.

    Long documents reach ``most`` first. Words and weights are summed by size,
    so a source has as many rows here as its documents have different lengths;
    filling up from the longest, the first lengths that would go beyond
    ``most`` are held at it and the rest share what remains.
    """
    per = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")).withColumn("w", weight(F.col("size")))
    s = small_side(t).alias("t")
    per = per.alias("p").join(s, F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "t.target")
    longer = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    words, weighted = F.col("size") * F.col("n"), F.col("size") * F.col("n") * F.col("w")
    per = per.withColumn("held", F.coalesce(F.sum(words).over(longer), F.lit(0)) * most).withColumn("sum_w", F.sum(weighted).over(rest))
    per = per.withColumn("rate", (F.col("target") - F.col("held")) / F.col("sum_w"))
    # the rate falls to its answer at the first length that need not be held: before it every one would go beyond ``most``
    fits = per.where(F.col("rate") * F.col("w") <= most)
    found = fits.groupBy("source").agg(F.max_by("rate", "size").alias("rate"))
    out = t.alias("t").join(found.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source")), "left")
    # where every length is held, whatever rate is high enough says so
    full = F.when(F.col("t.target") > 0, F.lit(float(most))).otherwise(0.0)
    return out.select("t.*", F.coalesce("f.rate", full).alias("rate"))


def due(rate: Column, w: Column, most: int = MOST) -> Column:
    """Copies that a document is due."""
    return F.least(F.lit(float(most)), rate * w)


def plan(sized: DataFrame, staging: Staging, weights: Sequence[int] = WEIGHTS, share: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """Per source: size, target, rate, and the last order statistic that is taken once more (null: none) with its range.

    ``sized`` has ``source``, ``size`` and ``u``. Words are summed by ranges of
    the order statistic, so only the range where a source's target is reached
    is ranked row by row.
    """
    t = staging.save(targets(sized, weights, share, most))
    t = staging.save(rates(sized, t, most))
    rows = with_order(sized, t, most).where("size > 0")
    certain = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    out = t.alias("t").join(certain.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    t = staging.save(out.select("t.*", (F.col("target") - F.coalesce("certain", F.lit(0))).alias("rest")))
    keyed = with_order(sized, t, most).where("q is not null and size > 0").withColumn("range", _range())
    ranges = staging.save(keyed.groupBy("source", "rest", "range").agg(F.sum("size").alias("words")))
    so_far = Window.partitionBy("source").orderBy("range")
    ranges = ranges.withColumn("after", F.sum("words").over(so_far)).where("after > rest")
    first = Window.partitionBy("source").orderBy("range")
    border = ranges.withColumn("n", F.row_number().over(first)).where("n = 1").select("source", "range", (F.col("after") - F.col("words")).alias("base"))
    border = staging.save(border)
    same = F.col("b.source").eqNullSafe(F.col("k.source")) & (F.col("b.range") == F.col("k.range"))
    inside = keyed.alias("k").join(small_side(border).alias("b"), same).select("k.source", "k.rest", "k.q", "k.size", "b.base")
    inside = inside.groupBy("source", "rest", "base", "q").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("q")
    inside = inside.withColumn("after", F.col("base") + F.sum("words").over(order)).withColumn("before", F.col("after") - F.col("words"))
    # taken if what is taken comes nearer to the target by it
    inside = inside.withColumn("take", F.col("after") - F.col("rest") < F.col("rest") - F.col("before"))
    last = inside.groupBy("source").agg(F.max(F.when(F.col("take"), F.col("q"))).alias("q_in"))
    border_range = border.select(F.col("source").alias("bs"), "range")
    last = last.join(border_range, F.col("source").eqNullSafe(F.col("bs"))).select("source", "q_in", "range")
    out = t.alias("t").join(last.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left")
    return staging.save(out.select("t.*", "l.q_in", "l.range"))


def _range() -> Column:
    return F.floor(F.col("q") * RANGES)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it and wherever a filter carries it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _ranked(most: int) -> Column:
    """(whole, q): certain copies and the order statistic."""
    u = F.col("u")

    def statistic(p: Column) -> Column:
        odds = (u / (1 - u)) / (p / (1 - p))
        return F.when(p > 0, _bound(odds, lambda x: x / (1 + x)))

    whole = lambda d: F.struct(F.floor(d).alias("whole"), _bound(d - F.floor(d), statistic).alias("q"))
    return _bound(due(F.col("rate"), weight(F.col("size")), most), whole)


def with_order(sized: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """Rows with their source's figures, their certain copies ``whole`` and the order statistic ``q``; null where nothing is left to take.

    ``q`` is x / (1 + x) of x, the random odds over the inclusion odds: the same order, between 0 and 1.
    """
    s = small_side(sources).alias("s")
    joined = sized.alias("d").join(s, F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", *[f"s.{c}" for c in sources.columns if c != "source"])
    return joined.withColumn("ranked", _ranked(most)).select("*", "ranked.whole", "ranked.q").drop("ranked")


def copies(most: int = MOST) -> Column:
    """How often a row of :func:`with_order` over a finished plan is taken."""

    def taken(r: Column) -> Column:
        q, here = r["q"], F.floor(r["q"] * RANGES)
        # ranges before the border are in, the border's rows up to q_in; without a border (nothing over the rest) all are in
        more = F.when(q.isNull(), 0).when(F.col("range").isNull() | (here < F.col("range")), 1)
        return r["whole"] + more.when((here == F.col("range")) & (q <= F.col("q_in")), 1).otherwise(0)

    return _bound(_ranked(most), taken)


def _sized(docs: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), draw(F.col(key), F.col(text), seed).alias("u"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """One row for each row of ``docs``: key, size, source_size, target, taken (words, repeats counted).

    A null text has size 0; null sources are one source, the last; rows
    without a key are drawn by their text. Rows of equal size with equal draws
    are taken together. Very long texts are sized whole. An empty table gives
    an empty one; other columns are ignored.
    """
    staging = Staging(docs.sparkSession, "mixing")
    sized = staging.save(_sized(docs, key, text, source, seed))
    rows = with_order(sized, plan(sized, staging))
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", (copies() * F.col("size")).cast("bigint").alias("taken"))


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns and no others.

    Rows without words weigh like the shortest ones and are taken as their draw says. Columns may have any names.
    """
    staging = Staging(docs.sparkSession, "mixing")
    sized = staging.save(_sized(docs, key, text, source, seed))
    sources = plan(sized, staging)
    mine = docs.select(F.struct("*").alias("row"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), draw(F.col(key), F.col(text), seed).alias("u"))
    rows = with_order(mine, sources)
    taken = rows.select("row", copies().cast("int").alias("n")).where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("row.*")
