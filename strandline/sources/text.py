"""Text formats by ``spark.read.text`` and column expressions: SAM, VCF, GFF3, GTF, BED, FASTA, FASTQ, indexed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fields
from ..operators.joins import small_side

# What a line that is no record begins with, by dialect.
COMMENTS = {"sam": "@", "vcf": "#", "gff": "#", "gtf": "#", "bed": "#"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): the lines of text files; block-compressed ones must end in .gz to be read as such."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r$", "").alias("value"))


def is_header(value: Column, dialect: str) -> Column:
    return value.startswith(COMMENTS[dialect])


def table_rows(rows: DataFrame, dialect: str) -> DataFrame:
    """Records of a tab-delimited dialect with ``fields``, an array as long as the line has fields; no quoting."""
    v = F.col("value")
    return rows.where((F.length(v) > 0) & ~is_header(v, dialect)).withColumn("fields", F.split(v, "\t"))


def field(i: int) -> Column:
    """A record's i-th field; null past its last one."""
    return F.get("fields", F.lit(i))


def fields_from(i: int) -> Column:
    """A record's fields from the i-th on, however many."""
    return rest_of(F.col("fields"), i)


def rest_of(items: Column, i: int) -> Column:
    """An array's elements from the i-th (0-based) on; none past its end."""
    return F.slice(items, i + 1, F.size(items))


def uniform_arity(rows: DataFrame) -> DataFrame:
    """Fewest and most fields, and whether all records have as many."""
    n = F.size("fields")
    return rows.agg(F.min(n).cast("bigint").alias("fewest"), F.max(n).cast("bigint").alias("most"), (F.min(n) == F.max(n)).alias("uniform"))


# SAM


def sam_fields(rows: DataFrame) -> DataFrame:
    """Alignment records of SAM lines; sentinels are null, '=' is the read's own reference. Numbers that aren't raise."""
    r = table_rows(rows, "sam")
    text = lambda i: fields.missing(field(i), "*")
    number = lambda i, kind, none: F.nullif(field(i).cast(kind), F.lit(none).cast(kind))
    mate = F.when(field(6) == "=", text(2)).otherwise(text(6))
    return r.select(
        text(0).alias("name"), field(1).cast("int").alias("flags"), text(2).alias("ref_name"), number(3, "bigint", 0).alias("pos"), number(4, "int", 255).alias("mapq"),
        text(5).alias("cigar"), mate.alias("mate_ref_name"), number(7, "bigint", 0).alias("mate_pos"), field(8).cast("int").alias("tlen"),
        text(9).alias("sequence"), text(10).alias("quality"), sam_tags(fields_from(11)).alias("tags"),
    )


def sam_tags(items: Column) -> Column:
    """map<tag, struct<type, i, f, s, b>> of TG:T:VALUE items; the first of a repeated tag. Wide integers fit: i is a bigint."""
    parsed = F.transform(items, lambda t: F.struct(F.substring(t, 1, 2).alias("tag"), F.substring(t, 4, 1).alias("type"), F.substr(t, F.lit(6)).alias("raw")))
    keys = F.array_distinct(F.transform(parsed, lambda p: p["tag"]))
    first = lambda k: F.get(F.filter(parsed, lambda p: p["tag"] == k), F.lit(0))

    def value(p):
        t, raw = p["type"], p["raw"]
        numbers = rest_of(F.split(raw, ","), 1)
        return F.struct(
            t.alias("type"), F.when(t == "i", raw.cast("bigint")).alias("i"), F.when(t == "f", raw.cast("float")).alias("f"),
            F.when(t.isin("A", "Z", "H"), raw).alias("s"), F.when(t == "B", F.transform(numbers, lambda x: x.cast("double"))).alias("b"),
        )

    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, value(first(k)))))


def sam_header(rows: DataFrame) -> DataFrame:
    """(kind, tags): one row for each header line; comments have their text under 'text'."""
    h = rows.where(is_header(F.col("value"), "sam"))
    parts = F.split("value", "\t")
    pairs = F.transform(rest_of(parts, 1), lambda x: F.struct(F.substring(x, 1, 2), F.substr(x, F.lit(4))))
    kind = F.substring(F.get(parts, F.lit(0)), 2, 2)
    text = F.map_from_arrays(F.array(F.lit("text")), F.array(F.substr("value", F.lit(5))))
    return h.select(kind.alias("kind"), F.when(kind == "CO", text).otherwise(F.map_from_entries(pairs)).alias("tags"))


def reference_sequences(header: DataFrame) -> DataFrame:
    return header.where("kind = 'SQ'").select(F.col("tags")["SN"].alias("ref_name"), F.col("tags")["LN"].cast("bigint").alias("ref_length"))


# VCF


def vcf_fields(rows: DataFrame) -> DataFrame:
    """Variant records of VCF lines: missing values null, lists as arrays, ``info`` and ``samples`` as text and arrays of text."""
    r = table_rows(rows, "vcf")
    arity = F.when(F.size("fields") < 8, F.raise_error(F.lit("a record has eight fields at least")).cast("string"))
    m = lambda i: fields.missing(field(i))
    return r.select(
        F.coalesce(arity, field(0)).alias("chrom"), F.nullif(field(1).cast("bigint"), F.lit(0).cast("bigint")).alias("pos"), fields.listed(field(2), ";").alias("ids"),
        field(3).alias("ref"), fields.listed(field(4), ",").alias("alts"), m(5).cast("float").alias("qual"), fields.listed(field(6), ";").alias("filters"),
        fields.checked_info(field(7)).alias("info"), m(8).alias("format"), fields_from(9).alias("samples"),
    )


def vcf_header(rows: DataFrame) -> DataFrame:
    """(key, id, number, type, description, value): one row for each '##' line; value is what isn't in angle brackets."""
    h = rows.where(F.col("value").startswith("##"))
    v, inside = F.col("value"), F.regexp_extract("value", r"^##[^=]+=<(.*)>$", 1)
    pick = lambda k: F.nullif(F.regexp_extract(inside, rf'(?:^|,){k}=("(?:[^"\\]|\\.)*"|[^,]*)', 1), F.lit(""))
    return h.select(
        F.regexp_extract(v, r"^##([^=]+)=", 1).alias("key"), pick("ID").alias("id"), pick("Number").alias("number"), pick("Type").alias("type"),
        F.trim(pick("Description"), F.lit('"')).alias("description"), F.when(inside == "", F.regexp_extract(v, r"^##[^=]+=(.*)$", 1)).alias("value"),
    )


def vcf_samples(rows: DataFrame) -> DataFrame:
    """(idx, sample): sample names in order."""
    names = rows.where(F.col("value").startswith("#CHROM\t")).select(rest_of(F.split("value", "\t"), 9).alias("s"))
    return names.select(F.posexplode("s").alias("idx", "sample"))


# GFF3, GTF, BED


def checked_strand(value: Column) -> Column:
    return F.when(value.isin("+", "-", ".", "?"), value).otherwise(F.raise_error(F.lit("invalid strand")))


def checked_phase(value: Column) -> Column:
    return F.when(value == ".", None).when(value.isin("0", "1", "2"), value.cast("tinyint")).otherwise(F.raise_error(F.lit("invalid phase")).cast("tinyint"))


def gff_kind(value: Column) -> Column:
    return F.when(value.startswith("##"), "directive").when(value.startswith("#"), "comment").otherwise("record")


def directives(rows: DataFrame) -> DataFrame:
    """(key, value, name, start_, end_): directives; sequence-region and genome-build in their parts, others as text."""
    d = rows.where(F.col("value").startswith("##")).select(F.split(F.substr("value", F.lit(3)), " ", 2).alias("p"))
    key, rest = F.col("p")[0], F.get("p", F.lit(1))
    parts = F.split(rest, r"\s+")
    region, build = key == "sequence-region", key == "genome-build"
    return d.select(
        key.alias("key"), F.when(region, None).when(build, parts[0]).otherwise(rest).alias("value"), F.when(region, parts[0]).when(build, F.get(parts, F.lit(1))).alias("name"),
        F.when(region, F.get(parts, F.lit(1)).cast("bigint")).alias("start_"), F.when(region, F.get(parts, F.lit(2)).cast("bigint")).alias("end_"),
    )


def line_table(spark: SparkSession, path: str, **columns: Column) -> DataFrame:
    """(path, line_no, line_offset, ...): the lines of text files with their number and byte in the file, in splits.

    ``columns`` are computed from ``value``, a line without its break, before
    anything is shuffled. Within a split lines come in order; how many lines
    and bytes the splits before it hold is a table of a row a split. Lines end
    in a line feed, with or without a carriage return.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"),
        (F.octet_length("value") + 1).cast("bigint").alias("bytes"), F.regexp_replace("value", "\r$", "").alias("value"),
    )
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    per = raw.groupBy("path", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum("bytes").alias("total"))
    per = per.select("path", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("bytes_before"))
    rows = raw.select("path", "split", "at", "bytes", *[c.alias(n) for n, c in columns.items()]).join(small_side(per), ["path", "split"])
    return rows.withColumn("line_no", (F.col("lines_before") + F.col("at") - F.col("first")).cast("bigint")).drop("lines_before", "first")


def with_line_offsets(rows: DataFrame) -> DataFrame:
    """Rows of :func:`line_table` with ``offset``, the line's first byte: a sum within its split and what came before."""
    w = Window.partitionBy("path", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", (F.coalesce(F.sum("bytes").over(w), F.lit(0)) + F.col("bytes_before")).cast("bigint"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value): lines with their place in the file, for formats where order matters."""
    return line_table(spark, path, value=F.col("value")).select("path", "line_no", "value")


def before_fasta(rows: DataFrame) -> DataFrame:
    """Numbered lines of GFF3 before a '##FASTA' line of their file."""
    stop = rows.where(F.col("value") == "##FASTA").groupBy("path").agg(F.min("line_no").alias("stop"))
    joined = rows.join(small_side(stop), "path", "left")
    return joined.where(F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))).drop("stop")


def _nine(rows: DataFrame, dialect: str, attributes: Column) -> DataFrame:
    r = table_rows(rows, dialect)
    m = lambda i: fields.missing(field(i))
    return r.select(
        field(0).alias("seqid"), field(1).alias("source"), field(2).alias("type"), field(3).cast("bigint").alias("start"), field(4).cast("bigint").alias("end"),
        m(5).cast("float").alias("score"), checked_strand(field(6)).alias("strand"), checked_phase(field(7)).alias("phase"), attributes.alias("attributes"),
    )


def gff_fields(rows: DataFrame) -> DataFrame:
    return _nine(rows, "gff", fields.gff_attributes(field(8)))


def gtf_fields(rows: DataFrame) -> DataFrame:
    return _nine(rows, "gtf", fields.gtf_attributes(field(8)))


def bed_fields(rows: DataFrame, n: int = 3) -> DataFrame:
    """BED records of ``n`` (3 to 6) standard fields and the rest as ``other``; starts become 1-based, an end of 0 is null."""
    if not 3 <= n <= 6:
        raise ValueError("a record has 3 to 6 standard fields")
    r = table_rows(rows, "bed")
    columns = [field(0).alias("chrom"), (field(1).cast("bigint") + 1).alias("start"), F.nullif(field(2).cast("bigint"), F.lit(0).cast("bigint")).alias("end")]
    columns += [fields.missing(field(3)).alias("name"), field(4).cast("int").alias("score"), fields.missing(field(5)).alias("strand")][: n - 3]
    return r.select(*columns, fields_from(n).alias("other"))


# FASTA, FASTQ


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, sequence): definitions split at the first white space, sequence lines joined, blank ones skipped."""
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    body = F.regexp_replace("value", "^>", "")
    definition = F.regexp_replace(F.substring_index(body, "\n", 1), "\r$", "")
    rest = F.when(F.contains(body, F.lit("\n")), F.substr(body, F.instr(body, "\n") + 1)).otherwise("")
    return raw.select(
        F.regexp_extract(definition, r"^(\S+)", 1).alias("name"), F.nullif(F.trim(F.regexp_extract(definition, r"^\S+\s(.*)$", 1)), F.lit("")).alias("description"),
        F.regexp_replace(rest, "[\r\n]", "").alias("sequence"),
    )


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, contig, name, start, bases): every sequence line with the 1-based position of its first base.

    Contigs may be of any length: none is a value of its own. What a split
    hands on to the next is how many contigs and bases it has, and how many
    bases behind its last definition.
    """
    v, head = F.col("value"), F.col("value").startswith(">")
    bases = F.regexp_replace(v, r"\s", "")
    r = line_table(spark, path, name=F.when(head, F.regexp_extract(v, r"^>(\S+)", 1)), bases=F.when(~head & (F.length(bases) > 0), bases), head=head.cast("int"))
    n = F.coalesce(F.length("bases"), F.lit(0)).cast("bigint")
    upto = Window.partitionBy("path", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("contig", F.sum("head").over(upto)).withColumn("so_far", F.sum(n).over(upto))
    r = r.withColumn("at_head", F.last(F.when(F.col("head") == 1, F.col("so_far")), ignorenulls=True).over(upto))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    per = r.groupBy("path", "split").agg(F.sum("head").alias("heads"), F.sum(n).alias("held"), F.max("at_head").alias("last_head"))
    per = per.withColumn("held_before", F.coalesce(F.sum("held").over(before), F.lit(0))).withColumn("heads_before", F.coalesce(F.sum("heads").over(before), F.lit(0)))
    # bases of the file before the last definition of the splits before
    per = per.withColumn("open_at", F.last(F.col("held_before") + F.col("last_head"), ignorenulls=True).over(before))
    r = r.join(small_side(per.select("path", "split", "held_before", "heads_before", "open_at")), ["path", "split"])
    contig, from_head = F.col("contig") + F.col("heads_before"), F.coalesce(F.col("held_before") + F.col("at_head"), "open_at")
    r = r.select("path", contig.alias("contig"), "name", "bases", (F.col("held_before") + F.col("so_far") - n - from_head + 1).alias("start"))
    names = r.where("name is not null").select("path", "contig", "name")
    return r.where("bases is not null and contig > 0").drop("name").join(small_side(names), ["path", "contig"]).select("path", "contig", "name", "start", "bases")


def subsequences(lines: DataFrame, wanted: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """``wanted`` (name, start, end; closed) with ``bases`` from :func:`fasta_lines`; intervals that reach past their contig have none.

    Lines and intervals meet in buckets of positions, so a contig with very
    many intervals is many keys.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket)))
    pieces = lines.select("name", F.col("start").alias("at"), "bases", buckets(F.col("start"), F.col("start") + F.length("bases") - 1).alias("bucket"))
    asked = wanted.select("name", "start", "end").distinct().withColumn("bucket", buckets(F.col("start"), F.col("end")))
    met = asked.join(pieces, ["name", "bucket"]).where((F.col("at") <= F.col("end")) & (F.col("at") + F.length("bases") - 1 >= F.col("start")))
    low, high = F.greatest("start", "at"), F.least(F.col("end"), F.col("at") + F.length("bases") - 1)
    # a line that lies in two buckets of an interval counts in the first one it shares with it
    met = met.where(F.col("bucket") == F.floor(low / bucket))
    cut = F.substr("bases", (low - F.col("at") + 1).cast("int"), (high - low + 1).cast("int"))
    found = met.groupBy("name", "start", "end").agg(F.sort_array(F.collect_list(F.struct(low.alias("p"), cut.alias("b")))).alias("x"))
    bases = F.array_join(F.transform("x", lambda x: x["b"]), "")
    whole = F.when(F.length(bases) == F.col("end") - F.col("start") + 1, bases)
    return wanted.join(found.select("name", "start", "end", whole.alias("bases")), ["name", "start", "end"], "left")


def fastq_records(rows: DataFrame) -> DataFrame:
    """(path, record, name, description, sequence, quality) of numbered lines; what follows the plus sign is ignored.

    A record that doesn't begin with '@', lacks its plus line or has qualities
    of another length than its bases raises.
    """
    r = rows.where("length(value) > 0 or line_no % 4 in (1, 3)")
    at = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.col("value")))
    g = r.groupBy("path", F.floor(F.col("line_no") / 4).alias("record")).agg(at(0).alias("d"), at(1).alias("sequence"), at(2).alias("plus"), at(3).alias("quality"))
    g = g.where("d is not null or sequence <> ''")
    bad = ~F.coalesce(F.col("d").startswith("@") & F.col("plus").startswith("+") & (F.length("sequence") == F.length("quality")), F.lit(False))
    definition = F.substr("d", F.lit(2))
    rest = F.when(F.contains(definition, F.lit(" ")), F.substr(definition, F.instr(definition, " ") + 1))
    return g.select(
        "path", "record", F.when(bad, F.raise_error(F.lit("invalid FASTQ record"))).otherwise(F.substring_index(definition, " ", 1)).alias("name"), rest.alias("description"), "sequence", "quality",
    )


def fastq_candidates(rows: DataFrame, key: str = "path") -> DataFrame:
    """Numbered lines with whether a record may begin there: '@', then two lines on '+', then as many characters as bases."""
    w = Window.partitionBy(key).orderBy("line_no")
    v, seq, plus, qual = F.col("value"), F.lead("value", 1).over(w), F.lead("value", 2).over(w), F.lead("value", 3).over(w)
    ok = v.startswith("@") & plus.startswith("+") & (F.length(seq) == F.length(qual))
    return rows.withColumn("candidate", F.coalesce(ok, F.lit(False)))


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """Per contig length, offset of the first base, bases and bytes of a line.

    Lines before a contig's last must be equally long; an empty contig or a
    ragged one raises. What is shuffled has no bases in it, and contigs are
    summed where their lines are.
    """
    v, head = F.col("value"), F.col("value").startswith(">")
    r = line_table(spark, path, name=F.when(head, F.regexp_extract(v, r"^>(\S+)", 1)), bases=F.when(~head & (F.length(v) > 0), F.length(v).cast("bigint")), head=head.cast("int"))
    r = with_line_offsets(r)
    # contigs are numbered within a split; those before it are counted by split
    heads = r.groupBy("path", "split").agg(F.sum("head").alias("heads"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("path", "split", F.coalesce(F.sum("heads").over(before), F.lit(0)).alias("heads_before"))
    upto = Window.partitionBy("path", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    r = r.join(small_side(heads), ["path", "split"]).withColumn("contig", F.sum("head").over(upto) + F.col("heads_before"))
    at = F.when(F.col("bases").isNotNull(), F.col("line_no"))
    first = F.min_by(F.struct("offset", "bases", "bytes"), at)
    g = r.groupBy("path", "contig").agg(
        F.max("name").alias("name"), F.sum("bases").cast("bigint").alias("length"), first.alias("first"), F.max_by("bases", at).alias("last"),
        F.max("bases").alias("widest"), F.count("bases").alias("n"),
    )
    line = F.col("first.bases")
    ragged = (F.col("length") != line * (F.col("n") - 1) + F.col("last")) | (F.col("widest") > line)
    name = F.when(F.col("n") == 0, F.raise_error(F.lit("empty contig"))).when(ragged, F.raise_error(F.lit("ragged contig"))).otherwise(F.col("name"))
    return g.where("contig > 0").select(name.alias("name"), "length", F.col("first.offset").alias("offset"), line.alias("line_bases"), F.col("first.bytes").alias("line_width"))


def fastq_index(spark: SparkSession, path: str) -> DataFrame:
    """Per read length, offsets of bases and qualities, line bases and width."""
    v = F.col("value")
    r = with_line_offsets(line_table(spark, path, name=F.regexp_extract(v, r"^@(\S+)", 1), blank=F.length(v) == 0, length=F.length(v).cast("bigint")))
    pick = lambda k, c: F.max(F.when(F.col("line_no") % 4 == k, F.col(c)))
    g = r.groupBy("path", F.floor(F.col("line_no") / 4).alias("record")).agg(
        pick(0, "name").alias("name"), pick(0, "blank").alias("blank"), pick(1, "length").alias("length"), pick(1, "offset").alias("offset"), pick(1, "bytes").alias("line_width"), pick(3, "offset").alias("qual_offset")
    )
    return g.where("not blank").select("name", "length", "offset", F.col("length").alias("line_bases"), "line_width", "qual_offset")


def base_offset(position0: Column, offset: Column, line_bases: Column, line_width: Column) -> Column:
    """Byte of a 0-based position in an indexed sequence."""
    return offset + F.floor(position0 / line_bases) * line_width + position0 % line_bases


# Index tables


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="name string, length bigint, offset bigint, line_bases bigint, line_width bigint", quote="")


def read_fastq_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="name string, length bigint, offset bigint, line_bases bigint, line_width bigint, qual_offset bigint", quote="")


_CRAI = "ref_id int, start bigint, span bigint, offset bigint, landmark bigint, slice_length bigint"


def read_crai(spark: SparkSession, path: str) -> DataFrame:
    """CRAI rows; the file must end in .gz to be read as compressed. -1 is no reference, 0 no start."""
    return _crai_nulls(spark.read.csv(path, sep="\t", schema=_CRAI, quote=""))


def crai_fields(lines: DataFrame) -> DataFrame:
    """CRAI rows of lines (``value``) that were decompressed otherwise."""
    return _crai_nulls(lines.select(F.from_csv("value", _CRAI, {"sep": "\t"}).alias("r")).select("r.*"))


def _crai_nulls(raw: DataFrame) -> DataFrame:
    return raw.withColumn("ref_id", F.nullif("ref_id", F.lit(-1))).withColumn("start", F.nullif("start", F.lit(0).cast("bigint")))


def indexed_rows(rows: DataFrame, name_column: int, start_column: int, end_column: int | None, comment: str = "#", zero_based: bool = False, *keep: str) -> DataFrame:
    """Lines of an indexed table with ``ref_name``, ``start``, ``end`` by the index header's 1-based column roles, and columns to keep."""
    r = rows.where((F.length("value") > 0) & ~F.col("value").startswith(comment)).withColumn("fields", F.split("value", "\t"))
    start = field(start_column - 1).cast("bigint") + (1 if zero_based else 0)
    end = field(end_column - 1).cast("bigint") if end_column else start
    return r.select("value", field(name_column - 1).alias("ref_name"), start.alias("start"), end.alias("end"), *keep)
