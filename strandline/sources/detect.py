"""What a file holds, told by its first bytes."""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords
from . import bgzf, files


def _inside(head: bytes) -> bytes:
    """The first bytes that a gzip member inflates to."""
    return zlib.decompressobj(31).decompress(head, 16)


def alignment_format(head: bytes) -> str:
    """bam, raw bam, sam, sam.gz or cram, by the first bytes of a file; any gzip is taken as blocked."""
    if head[:2] == b"\x1f\x8b":
        inside = _inside(head)
        if inside[:4] == b"CRAM":
            raise ValueError("a CRAM file isn't compressed as a whole")
        return "bam" if inside[:4] == b"BAM\x01" else "sam.gz"
    return "raw bam" if head[:4] == b"BAM\x01" else "cram" if head[:4] == b"CRAM" else "sam"


def variant_format(head: bytes) -> str:
    if head[:2] == b"\x1f\x8b":
        return "bcf" if _inside(head)[:3] == b"BCF" else "vcf.gz"
    return "raw bcf" if head[:3] == b"BCF" else "vcf"


def head_of(path: str, n: int = 4096) -> bytes:
    from .indexes import SUFFIXES

    file = files.open_file(next(p for p, _ in files.list_files(path) if not p.endswith(SUFFIXES)))
    return file.read_at(min(n, file.size()), 0)


def read_header(path: str):
    """The header of an alignment file, or of a folder's first one; its records aren't read."""
    from . import bam, cram
    from .indexes import SUFFIXES

    first = next(p for p, _ in files.list_files(path) if not p.endswith(SUFFIXES))
    file, kind = files.open_file(first), alignment_format(head_of(first))
    if kind in ("bam", "raw bam"):
        return bam.read_header(file)[0]
    if kind == "cram":
        return cram.Containers(file).sam_header()
    return cram.parse_sam_header("\n".join(_lines_while(file, kind, "@")) + "\n")


def read_variant_header(path: str) -> list[str]:
    """The header lines of a variant file, or of a folder's first one."""
    from . import bcf
    from .indexes import SUFFIXES

    first = next(p for p, _ in files.list_files(path) if not p.endswith(SUFFIXES))
    file, kind = files.open_file(first), variant_format(head_of(first))
    return bcf.read_header(file)[0].lines if kind in ("bcf", "raw bcf") else _lines_while(file, kind, "#")


def _lines_while(file, kind: str, mark: str) -> list[str]:
    """Lines from a file's beginning as long as they begin with a mark; text or blocked gzip, read piece by piece."""
    pieces = (data for _, _, data in bgzf.BlockReader(file)) if kind.endswith(".gz") else (file.read_at(min(1 << 16, file.size() - at), at) for at in range(0, file.size(), 1 << 16))
    out, held = [], b""
    for piece in pieces:
        *whole, held = (held + piece).split(b"\n")
        for line in whole:
            if not line.startswith(mark.encode()):
                return out
            out.append(line.decode().removesuffix("\r"))
    return out + ([held.decode()] if held.startswith(mark.encode()) else [])


def register(spark: SparkSession) -> None:
    """Make the formats bam, bcf, cram and bgzf_lines known to a session, and let Spark tell them its filters."""
    from .bam import BamSource
    from .bcf import BcfSource
    from .cram import CramSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (BamSource, BcfSource, CramSource, bgzf.BgzfLines):
        spark.dataSource.register(source)


def read_alignments(spark: SparkSession, path: str, regions: Sequence[str] = (), reference: Sequence[str] = ()) -> DataFrame:
    """Alignment records of SAM, compressed SAM, BAM (blocked or not) or CRAM files, in the SAM source's columns that all have.

    With ``regions`` only records that meet one come; of files with an index
    beside them, which compressed SAM and BAM must have then, only the blocks
    that may hold some are read. CRAM may need ``reference``, FASTA files.
    """
    from ..functions import records
    from . import text

    register(spark)
    kind, wanted = alignment_format(head_of(path)), json.dumps(list(regions))
    if kind in ("bam", "raw bam"):
        source = spark.read.format("bam")
        return (source.option("regions", wanted) if regions else source).load(path)
    if kind == "cram":
        source = spark.read.format("cram").option("reference", json.dumps(list(reference)))
        return (source.option("regions", wanted) if regions else source).load(path)
    if kind == "sam":
        rows = text.sam_fields(text.lines(spark, path))
    elif kind == "sam.gz":
        source = spark.read.format("bgzf_lines")
        rows = text.sam_fields((source.option("regions", wanted) if regions else source).load(path))
    else:
        raise ValueError(f"not supported: {kind}")
    return rows.where(_in_any(regions, F.col("ref_name"), F.col("pos"), records.alignment_end(F.col("pos"), F.col("cigar")))) if regions else rows


def read_variants(spark: SparkSession, path: str, regions: Sequence[str] = ()) -> DataFrame:
    """Variant records of VCF, compressed VCF or BCF files; ``regions`` as for :func:`read_alignments`."""
    from ..functions import fields
    from . import bcf, text

    register(spark)
    kind, wanted = variant_format(head_of(path)), json.dumps(list(regions))
    if kind in ("bcf", "raw bcf"):
        source = spark.read.format("bcf")
        rows = (source.option("regions", wanted) if regions else source).load(path)
        end = bcf.last_position()
    elif kind in ("vcf", "vcf.gz"):
        if kind == "vcf":
            lines = text.lines(spark, path)
        else:
            source = spark.read.format("bgzf_lines")
            lines = (source.option("regions", wanted) if regions else source).load(path)
        rows = text.vcf_fields(lines)
        end = fields.variant_end(F.col("pos"), F.col("ref"), F.col("info"))
    else:
        raise ValueError(f"not supported: {kind}")
    return rows.where(_in_any(regions, F.col("chrom"), F.col("pos"), end)) if regions else rows


def read_indexed_lines(spark: SparkSession, path: str, regions: Sequence[str]) -> DataFrame:
    """Lines of block-compressed tables that meet one of the regions, with ``ref_name``, ``start`` and ``end``.

    Which columns these are the index beside the first file says.
    """
    from . import indexes, text

    register(spark)
    first = next(p for p, _ in files.list_files(path) if not p.endswith(indexes.SUFFIXES))
    c = indexes.beside(first).columns
    lines = spark.read.format("bgzf_lines").option("regions", json.dumps(list(regions))).load(path)
    rows = text.indexed_rows(lines, c["name"], c["start"], c["end"] or None, chr(c["comment"]), bool(c["zero_based"]))
    return rows.where(_in_any(regions, F.col("ref_name"), F.col("start"), F.col("end")))


def _in_any(regions: Sequence[str], name, start, end):
    met = F.lit(False)
    for r in map(coords.parse_region, regions):
        met = met | coords.in_region(r, name, start, end)
    return met
