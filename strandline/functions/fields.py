"""Fields of variant and annotation records: attributes, INFO, samples, genotypes, sentinels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(value: Column, sentinel: str = ".") -> Column:
    return F.nullif(value, F.lit(sentinel))


def listed(value: Column, separator: str) -> Column:
    """The items of a field; none where it is missing."""
    return F.when(value == ".", F.array().cast("array<string>")).otherwise(F.split(value, separator))


def percent_decode(value: Column) -> Column:
    """%XX sequences decoded, plus signs kept; the value itself where it isn't well-formed."""
    plain = F.replace(value, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(plain), value)


def percent_encode(value: Column) -> Column:
    """What has a meaning in GFF3 columns: the percent sign first, then tab, newline, return, ;=&,"""
    for c, code in (("%", "%25"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"), (";", "%3B"), ("=", "%3D"), ("&", "%26"), (",", "%2C")):
        value = F.replace(value, F.lit(c), F.lit(code))
    return value


def keyed(text: Column, separator: str = ";") -> Column:
    """array<struct<k, v>> of ``k=v`` items in order; v is null for a key alone."""
    items = F.filter(F.split(text, separator), lambda x: x != "")
    return F.transform(
        items,
        lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.substr(x, F.instr(x, "=") + 1)).alias("v")),
    )


def first_of(pairs: Column, key: str) -> Column:
    """The value of the first item with a key; null without one."""
    return F.get(F.filter(pairs, lambda x: x["k"] == key), F.lit(0))["v"]


def info_value(info: Column, key: str) -> Column:
    """An INFO field's raw text by its first occurrence; '.' is null. A flag is null too, see :func:`info_flag`."""
    return missing(F.nullif(F.regexp_extract(info, f"(?:^|;){key}=([^;]*)", 1), F.lit("")))


def info_flag(info: Column, key: str) -> Column:
    return info.rlike(f"(^|;){key}(;|=|$)")


def checked_info(info: Column) -> Column:
    """INFO text; an error for empty keys and a trailing separator."""
    bad = info.rlike("(^|;)(=|;|$)") & (info != ".")
    return F.when(bad, F.raise_error(F.lit("invalid INFO field"))).otherwise(info)


def info_typed(raw: Column, number: str, kind: str) -> Column:
    """A raw value by its header's Number and Type: a scalar for 1, else an array with nulls for '.'; 0 is a flag."""
    types = {"Integer": "int", "Float": "float", "Character": "string", "String": "string"}
    if kind == "Flag" or number == "0":
        if kind != "Flag" or number != "0":
            raise ValueError("a flag has number 0 and no other type has")
        return raw.isNotNull()
    text = (lambda c: percent_decode(c)) if kind in ("String", "Character") else (lambda c: c)
    if number == "1":
        return text(missing(raw)).cast(types[kind])
    return F.transform(F.split(raw, ","), lambda x: text(missing(x)).cast(types[kind]))


def sample_values(format_: Column, sample: Column) -> Column:
    """array<struct<k, v>>: keys and values paired as far as both go; '.' is null."""
    keys, values = F.split(format_, ":"), F.split(sample, ":")
    n = F.least(F.size(keys), F.size(values))
    return F.transform(F.slice(keys, F.lit(1), n), lambda k, i: F.struct(k.alias("k"), missing(F.get(values, i)).alias("v")))


def genotype_alleles(gt: Column) -> Column:
    """Allele numbers, null for '.'; an error for an empty genotype."""
    found = F.regexp_extract_all(gt, F.lit(r"[|/]?([0-9]+|\.)"), 1)
    return F.when(gt == "", F.raise_error(F.lit("empty genotype")).cast("array<int>")).otherwise(F.transform(found, lambda a: missing(a).cast("int")))


def genotype_phasing(gt: Column) -> Column:
    """Whether each allele is phased. The first one's sign may be left out: it is unphased if any slash follows."""
    signs = F.regexp_extract_all(gt, F.lit(r"([|/]?)(?:[0-9]+|\.)"), 1)
    first = ~F.contains(gt, F.lit("/"))
    return F.transform(signs, lambda s, i: F.when(s == "|", True).when(s == "/", False).otherwise(first))


def gff_value(attributes: Column, key: str) -> Column:
    """An attribute's raw value by its first occurrence."""
    return F.nullif(F.regexp_extract(attributes, f"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def gff_attributes(attributes: Column) -> Column:
    """map<string, array<string>>: decoded, comma lists split, the first of a repeated key."""
    pairs = F.when(attributes == ".", F.array().cast("array<struct<k:string,v:string>>")).otherwise(keyed(attributes))
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    value = lambda k: F.get(F.filter(pairs, lambda x: x["k"] == k), F.lit(0))["v"]
    entries = F.transform(keys, lambda k: F.struct(percent_decode(k), F.transform(F.split(value(k), ","), percent_decode)))
    return F.map_from_entries(entries)


def gff_text(attributes: Column) -> Column:
    """Attribute column text of a map, keys in order of the map."""
    return F.when(F.size(attributes) == 0, ".").otherwise(
        F.array_join(
            F.transform(
                F.map_entries(attributes),
                lambda e: F.concat(percent_encode(e["key"]), F.lit("="), F.array_join(F.transform(e["value"], percent_encode), ",")),
            ),
            ";",
        )
    )


_GTF = r'([^\s;"]+)\s+(?:"([^"]*)"|([^;"]*))\s*(?:;|$)'


def gtf_attributes(attributes: Column) -> Column:
    """map<string, array<string>>: values of a repeated key in order, quotes off, a raw value up to the semicolon."""
    keys = F.regexp_extract_all(attributes, F.lit(_GTF), 1)
    quoted, raw = F.regexp_extract_all(attributes, F.lit(_GTF), 2), F.regexp_extract_all(attributes, F.lit(_GTF), 3)
    pairs = F.transform(keys, lambda k, i: F.struct(k.alias("k"), F.concat(F.get(quoted, i), F.trim(F.get(raw, i))).alias("v")))
    values = lambda k: F.transform(F.filter(pairs, lambda x: x["k"] == k), lambda x: gtf_unescape(x["v"]))
    return F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k, values(k))))


def gtf_unescape(value: Column) -> Column:
    return F.regexp_replace(value, r'\\([\\"])', "$1")


def gtf_text(attributes: Column) -> Column:
    pair = lambda k: lambda v: F.concat(k, F.lit(' "'), F.regexp_replace(v, r'([\\"])', r"\\$1"), F.lit('";'))
    return F.array_join(F.flatten(F.transform(F.map_entries(attributes), lambda e: F.transform(e["value"], pair(e["key"])))), " ")


def variant_end(pos: Column, ref: Column, info: Column, before_4_5: bool = True, sample_lengths: Column | None = None) -> Column:
    """Last position of a variant. Before VCF 4.5 INFO/END if given, else the reference bases' length; from 4.5 on the longest of reference bases, SVLEN and samples' LEN."""
    start = F.coalesce(pos, F.lit(1).cast("bigint"))
    if before_4_5:
        return F.coalesce(info_value(info, "END").cast("bigint"), start + F.length(ref) - 1)
    lengths = F.transform(F.split(info_value(info, "SVLEN"), ","), lambda x: missing(x).cast("bigint"))
    longest = F.greatest(F.length(ref).cast("bigint"), F.array_max(lengths), sample_lengths if sample_lengths is not None else F.lit(None).cast("bigint"))
    return start + longest - 1
