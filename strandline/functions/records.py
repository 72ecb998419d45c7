"""Flags, CIGARs, sequences and qualities of alignment records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flag bits (SAM specification).
FLAGS = {
    "segmented": 0x1,
    "properly_segmented": 0x2,
    "unmapped": 0x4,
    "mate_unmapped": 0x8,
    "reverse_complemented": 0x10,
    "mate_reverse_complemented": 0x20,
    "first_segment": 0x40,
    "last_segment": 0x80,
    "secondary": 0x100,
    "qc_fail": 0x200,
    "duplicate": 0x400,
    "supplementary": 0x800,
}
# Codes of bases and CIGAR operations in binary records.
BASE_CODES = "=ACMGRSVTWYHKDBN"
CIGAR_CODES = "MIDNSHP=X"
CONSUMES_READ = "MIS=X"
CONSUMES_REFERENCE = "MDN=X"
# Complements, one table for reference sequences, one for reads.
COMPLEMENT_FROM = "ACGTUWSMKRYBDHVNacgtuwsmkrybdhvn"
COMPLEMENT_TO = "TGCAAWSKMYRVHDBNtgcaawskmyrvhdbn"
READ_FROM = "=ACMGRSVTWYHKDB"
READ_TO = "=TGKCYSBAWRDMHV"
# Ambiguity codes and the first base alphabetically that each stands for.
REDUCE_FROM = "WMRDHVSYBKwmrdhvsybk"
REDUCE_TO = "AAAAAACCCGaaaaaacccg"

DEPTH_EXCLUDED = FLAGS["unmapped"] | FLAGS["secondary"] | FLAGS["qc_fail"] | FLAGS["duplicate"]
NOT_PRIMARY = FLAGS["secondary"] | FLAGS["supplementary"]


def has(flags: Column, *names: str) -> Column:
    """Whether any of the named bits is set."""
    mask = 0
    for n in names:
        mask |= FLAGS[n]
    return flags.bitwiseAND(F.lit(mask)) != 0


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len, op>> of a CIGAR text; empty where it is missing."""
    pattern = F.lit(r"(\d+)([MIDNSHP=X])")
    text = F.coalesce(cigar, F.lit(""))
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("n"), F.regexp_extract_all(text, pattern, 2).alias("op")),
        lambda x: F.struct(x["n"].cast("bigint").alias("len"), x["op"].alias("op")),
    )


def _sum_ops(cigar: Column, kinds: str) -> Column:
    lengths = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(rf"(\d+)[{kinds}]"), 1)
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, n: a + n.cast("bigint"))


def alignment_span(cigar: Column) -> Column:
    """Reference bases that a CIGAR covers; null for none."""
    return F.nullif(_sum_ops(cigar, CONSUMES_REFERENCE), F.lit(0))


def read_length(cigar: Column) -> Column:
    return _sum_ops(cigar, CONSUMES_READ)


def alignment_end(pos: Column, cigar: Column) -> Column:
    """Last reference position; the start itself where the CIGAR covers nothing."""
    return pos + F.coalesce(alignment_span(cigar), F.lit(1)) - 1


def consumes_read(op: Column) -> Column:
    return op.isin(*CONSUMES_READ)


def consumes_reference(op: Column) -> Column:
    return op.isin(*CONSUMES_REFERENCE)


def unpack_cigar_op(raw: Column) -> Column:
    code = raw.bitwiseAND(F.lit(15))
    return F.struct(F.shiftrightunsigned(raw, 4).cast("bigint").alias("len"), F.substring(F.lit(CIGAR_CODES), (code + 1).cast("int"), F.lit(1)).alias("op"))


def unpack_bases(packed: Column, length: Column) -> Column:
    """Bases packed two to a byte."""
    return F.substring(F.translate(F.hex(packed), "0123456789ABCDEF", BASE_CODES), F.lit(1), length.cast("int"))


def phred(quality: Column) -> Column:
    """Scores of a quality text, as an array; an error below '!'."""
    return F.transform(
        F.filter(F.split(quality, ""), lambda c: c != ""),
        lambda c: F.when(F.ascii(c) >= 33, F.ascii(c) - 33).otherwise(F.raise_error(F.lit("invalid quality score")).cast("int")),
    )


def phred_text(scores: Column) -> Column:
    """Quality text of scores; an error above 93, where '!' + score leaves the printable range."""
    return F.array_join(
        F.transform(scores, lambda q: F.when(q.between(0, 93), F.char((q + 33).cast("bigint"))).otherwise(F.raise_error(F.lit("invalid quality score")))), ""
    )


def complement(seq: Column) -> Column:
    """Complement of IUPAC bases, case kept; an error on others."""
    known = seq.rlike(f"^[{COMPLEMENT_FROM}]*$")
    return F.when(seq.isNull() | known, F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO)).otherwise(F.raise_error(F.lit("invalid base")))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def read_reverse_complement(seq: Column) -> Column:
    """Reverse complement of a read: '=' stays, what is unknown becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, f"[^{READ_FROM}]", "N"), READ_FROM, READ_TO))


def subsequence(seq: Column, start: Column, end: Column) -> Column:
    """Bases of a closed interval; null where it leaves the sequence, empty where the end is just before the start."""
    ok = (start >= 1) & (end <= F.length(seq)) & (start <= end + 1)
    return F.when(ok, F.substring(seq, start.cast("int"), (end - start + 1).cast("int")))


def sequence_digest(seq: Column) -> Column:
    """MD5 of a reference: printable characters only, upper-cased."""
    return F.md5(F.upper(F.regexp_replace(seq, "[^!-~]", "")).cast("binary"))


def reduce_bases(ref: Column) -> Column:
    """Ambiguity codes reduced to concrete bases; an error on what is no base."""
    ok = ref.rlike(f"^[ACGTNacgtn{REDUCE_FROM}]*$")
    return F.when(ref.isNull() | ok, F.translate(ref, REDUCE_FROM, REDUCE_TO)).otherwise(F.raise_error(F.lit("invalid reference base")))


def wrap(seq: Column, width: int = 80) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def percentage(n: Column, total: Column) -> Column:
    """Two decimals with a sign, or N/A of nothing."""
    return F.when(total == 0, "N/A").otherwise(F.format_string("%.2f%%", n.cast("double") / total * 100))


def modified_positions(seq: Column, base: str, skips: Column, reverse: Column) -> Column:
    """0-based positions of modified bases in a read as stored.

    ``skips`` counts the bases of the kind passed over before each modified
    one, from the 5' end of the original strand: for a reversed read from the
    end, on the complement.
    """
    other = dict(zip(COMPLEMENT_FROM[:16], COMPLEMENT_TO[:16], strict=True))[base]
    # the k-th modified base is the (sum of skips up to k + k)-th of its kind
    ranks = F.transform(skips, lambda _, k: F.aggregate(F.slice(skips, F.lit(1), k + 1), F.lit(0), lambda a, s: a + s + 1) - 1)
    size = F.length(seq)
    if base == "N":
        at = lambda r: F.when((r >= 0) & (r < size), r)
    else:
        # bases lie between pieces of the read; what is behind the last one that is asked for isn't cut
        ahead = F.when(reverse, F.reverse(seq)).otherwise(seq)
        wanted = F.when(reverse, F.lit(other)).otherwise(F.lit(base))
        pieces = F.split(ahead, wanted, F.coalesce(F.array_max(ranks), F.lit(0)) + 2)
        at = lambda r: F.when((r >= 0) & (r < F.size(pieces) - 1), F.aggregate(F.slice(pieces, F.lit(1), r + 1), r, lambda a, x: a + F.length(x)))
    return F.transform(ranks, lambda r: F.when(reverse, size - 1 - at(r)).otherwise(at(r)))
