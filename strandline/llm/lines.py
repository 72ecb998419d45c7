"""Line dedup by site-relative frequency (operator 2).

A line that stands on more than a given share of a host's pages is
boilerplate of that host and is dropped there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import BROADCAST_ROWS, Staging, small_side

#: Share of a host's pages, in percent, beyond which a line is boilerplate.
RATIO_PERCENT = 5
#: A line on fewer pages of a host repeats nothing. The ratio alone decides otherwise, whatever the host's size.
LEAST_COPIES = 2
#: Tasks that the pages of one (host, line) are dealt over where there are too many lines to send to every task.
SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _counts(line: Column) -> Column:
    """Whether a line has anything but white space; blank lines are neither counted nor dropped."""
    return F.length(F.translate(line, " \t\r\x0b\x0c", "")) > 0


def _print(line: Column) -> Column:
    """Sixteen bytes that stand for a line."""
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(docs: DataFrame, staging: Staging, host: str, text: str, percent: int = RATIO_PERCENT, copies: int = LEAST_COPIES) -> DataFrame:
    """(host, line): the prints of each host's boilerplate lines.

    A line that more than ``percent`` of the pages hold takes that share of all
    distinct lines of pages, so there are at most 100 / ``percent`` times as
    many of them as a page has distinct lines on average.
    """
    pages = docs.select(F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    totals = staging.save(pages.groupBy("host").agg(F.count("*").alias("pages")))
    on = pages.select("host", F.explode(_prints("text")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    on = on.where(F.col("n") >= copies)
    same = F.col("o.host").eqNullSafe(F.col("t.host"))
    found = on.alias("o").join(small_side(totals).alias("t"), same).where(F.col("n") * 100 > F.col("pages") * percent)
    return staging.save(found.select("o.host", "line"))


def _prints(text: str) -> Column:
    """A page's distinct lines, as prints."""
    return F.array_distinct(F.transform(F.filter(_lines(F.col(text)), _counts), _print))


def _marked(docs: DataFrame, host: str, text: str, percent: int, most: int) -> DataFrame:
    """``row`` (a struct of all columns), ``lines``, ``drop`` (an array of booleans beside them).

    Up to ``most`` boilerplate lines in all go to every task. Beyond that each
    page's lines look theirs up by (host, line), every key dealt over
    ``SALTS`` tasks, and only what was found joins the texts again.
    """
    staging = Staging(docs.sparkSession, "lines")
    found = boilerplate(docs, staging, host, text, percent)
    if found.limit(most + 1).count() <= most:
        per_host = found.groupBy("host").agg(F.collect_set("line").alias("boiler")).hint("broadcast")
        rows = docs.select(F.struct("*").alias("row"), F.col(host).cast("string").alias("host"), _lines(F.col(text)).alias("lines"))
        joined = rows.alias("r").join(per_host.alias("b"), F.col("r.host").eqNullSafe(F.col("b.host")), "left")
    else:
        rows = staging.save(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")))
        page = F.col("row").getField
        lines = rows.select("at", page(host).cast("string").alias("host"), page(text).alias("text")).select("at", "host", F.explode(_prints("text")).alias("line"))
        lines = lines.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)))
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = F.col("l.host").eqNullSafe(F.col("f.host")) & (F.col("l.line") == F.col("f.line")) & (F.col("l.salt") == F.col("f.salt"))
        own = lines.alias("l").join(salted.alias("f"), same).groupBy("at").agg(F.collect_set("l.line").alias("boiler"))
        joined = rows.join(own, "at", "left").select("row", _lines(page(text)).alias("lines"), "boiler")
    boiler = F.coalesce("boiler", F.array().cast("array<binary>"))
    drop = F.when(F.size(boiler) == 0, F.transform("lines", lambda x: F.lit(False))).otherwise(
        F.transform("lines", lambda x: _counts(x) & F.array_contains(boiler, _print(x)))
    )
    marked = joined.select("row", "lines", drop.alias("drop"))
    # a page of nothing else stays as it is
    left = F.exists(F.arrays_zip("lines", "drop"), lambda z: _counts(z["lines"]) & ~z["drop"])
    return marked.select("row", "lines", F.when(left, F.col("drop")).otherwise(F.transform("drop", lambda x: F.lit(False))).alias("drop"))


def _cleaned() -> Column:
    kept = F.filter(F.arrays_zip("lines", "drop"), lambda z: ~z["drop"])
    return F.when(F.exists("drop", lambda x: x), F.array_join(F.transform(kept, lambda z: z["lines"]), "\n"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", percent: int = RATIO_PERCENT, most: int = BROADCAST_ROWS) -> DataFrame:
    """All rows and columns of ``docs``, with boilerplate lines taken out of ``text``.

    Null hosts are one host. A null text stays null but counts as a page; so
    does an empty one. A page that holds nothing but boilerplate is left whole.
    Repeated rows count as pages of their own; an empty table gives an empty
    one. Very long texts are split into lines whole. Columns may have any
    names: they travel in a struct of their own.
    """
    marked = _marked(docs, host, text, percent, most)
    name = lambda c: F.col("row").getField(c)
    return marked.select(*[(F.coalesce(_cleaned(), name(c)) if c == text else name(c)).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", percent: int = RATIO_PERCENT, most: int = BROADCAST_ROWS) -> DataFrame:
    """Per row the key, its lines, the dropped ones, and the MD5 of the cleaned text (null for a null text).

    Rows are treated as by :func:`drop_boilerplate`; other columns, whatever
    their names, are ignored.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))
    marked = _marked(narrow, "host", "text", percent, most)
    dropped = F.size(F.filter("drop", lambda x: x)).cast("bigint")
    return marked.select(
        F.col("row.key").alias(key),
        F.coalesce(F.size("lines").cast("bigint"), F.lit(0).cast("bigint")).alias("n_lines"),
        F.coalesce(dropped, F.lit(0).cast("bigint")).alias("n_dropped"),
        F.md5(F.coalesce(_cleaned(), F.col("row.text")).cast("binary")).alias("text_md5"),
    )
