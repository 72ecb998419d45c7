from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline.functions import coords, fields, records
from strandline.functions.coords import Region, parse_region, region_bins


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column).first()[0]


def test_regions():
    assert parse_region("sq0") == Region("sq0")
    assert parse_region("sq0:8-13") == Region("sq0", 8, 13)
    assert parse_region("a:b:8") == Region("a:b", 8) and parse_region("sq0:") == Region("sq0")
    assert parse_region("sq0:9-5") == Region("sq0", 9, 5) and str(Region("x", None, 9)) == "x:1-9"
    for bad in ("", "sq0:0", "sq0:x", "sq0:5-", "sq0:-5"):
        with pytest.raises(ValueError):
            parse_region(bad)


@pytest.mark.parametrize(("start", "end"), [(1, 1), (100001, 140000), (16384, 16385), (1, (1 << 29) - 1), (1 << 20, (1 << 20) + 1), (536870911, 536870911)])
def test_bins_of_an_interval(spark, start, end):
    def smallest():
        for level in range(5, 0, -1):
            shift = 14 + 3 * (5 - level)
            if (start - 1) >> shift == (end - 1) >> shift:
                return ((1 << 3 * level) - 1) // 7 + ((start - 1) >> shift)
        return 0

    s, e = F.lit(start).cast("bigint"), F.lit(end).cast("bigint")
    assert one(spark, coords.bin_of(s, e)) == smallest()
    found = one(spark, coords.bins_of(s, e))
    assert sorted(found) == sorted(region_bins(Region("x", start, end))) and smallest() in found


def test_unknown_bins_and_empty_regions(spark):
    assert one(spark, coords.bin_of(F.lit(None).cast("bigint"), F.lit(3).cast("bigint"))) is None
    with pytest.raises(ValueError):
        region_bins(Region("x", 1 << 29))
    assert region_bins(Region("x", 9, 5)) == [] and len(region_bins(Region("x", 1, 1))) == 6
    assert one(spark, coords.in_region(Region("x", 5, 9), F.lit("x"), F.lit(None).cast("int"), F.lit(7))) is False


def test_cigars(spark):
    c = F.lit("5S10M2I3D4N6=1X2H")
    assert one(spark, records.alignment_span(c)) == 24 and one(spark, records.read_length(c)) == 24
    assert one(spark, records.alignment_end(F.lit(100), c)) == 123
    assert one(spark, records.alignment_span(F.lit("5S"))) is None and one(spark, records.alignment_end(F.lit(7), F.lit(None).cast("string"))) == 7
    assert [tuple(x) for x in one(spark, records.cigar_ops(F.lit("5S10M")))] == [(5, "S"), (10, "M")]
    assert one(spark, records.cigar_ops(F.lit(None).cast("string"))) == []


def test_sequences(spark):
    assert one(spark, records.reverse_complement(F.lit("ACGTUNacgtun"))) == "naacgtNAACGT"
    assert one(spark, records.read_reverse_complement(F.lit("=ACGX"))) == "NCGT="
    with pytest.raises(Exception, match="invalid base"):
        one(spark, records.complement(F.lit("AC!")))
    assert one(spark, records.unpack_bases(F.unhex(F.lit("12480F")), F.lit(5))) == "ACGT="
    assert one(spark, records.phred(F.lit("!I~"))) == [0, 40, 93] and one(spark, records.phred_text(F.array(F.lit(0), F.lit(93)))) == "!~"
    with pytest.raises(Exception, match="quality"):
        one(spark, records.phred_text(F.array(F.lit(94))))
    assert one(spark, records.subsequence(F.lit("ACGT"), F.lit(2), F.lit(3))) == "CG" and one(spark, records.subsequence(F.lit("ACGT"), F.lit(2), F.lit(5))) is None
    assert one(spark, records.subsequence(F.lit("ACGT"), F.lit(3), F.lit(2))) == ""
    assert one(spark, records.reduce_bases(F.lit("ACGTNRYKr"))) == "ACGTNACGa"
    assert one(spark, records.wrap(F.lit("ABCDEFG"), 3)) == "ABC\nDEF\nG"
    assert one(spark, records.percentage(F.lit(1), F.lit(0))) == "N/A" and one(spark, records.percentage(F.lit(1), F.lit(3))) == "33.33%"


def test_base_modifications(spark):
    seq = F.lit("CACCCGATGACCGGCT")
    skips = lambda *n: F.array(*[F.lit(x) for x in n])
    assert one(spark, records.modified_positions(seq, "C", skips(1, 3, 0), F.lit(False))) == [2, 11, 14]
    assert one(spark, records.modified_positions(seq, "C", skips(1, 0, 0), F.lit(True))) == [12, 8, 5]


def test_info(spark):
    info = F.lit("DP=7;DB;END=20;DP=9;S=.;X=a%3Bb")
    assert one(spark, fields.info_value(info, "DP")) == "7" and one(spark, fields.info_value(info, "S")) is None
    assert one(spark, fields.info_flag(info, "DB")) is True and one(spark, fields.info_flag(info, "D")) is False
    assert one(spark, fields.info_typed(fields.info_value(info, "X"), "1", "String")) == "a;b"
    assert one(spark, fields.info_typed(F.lit("1,.,3"), ".", "Integer")) == [1, None, 3]
    with pytest.raises(ValueError):
        fields.info_typed(info, "0", "Integer")
    for bad in ("DP=1;", ";DP=1", "=1", "A;;B"):
        with pytest.raises(Exception, match="INFO"):
            one(spark, fields.checked_info(F.lit(bad)))
    assert one(spark, fields.checked_info(F.lit("."))) == "."


@pytest.mark.parametrize(("gt", "alleles", "phased"), [("0/1", [0, 1], [False, False]), ("0|1", [0, 1], [True, True]), ("./.", [None, None], [False, False]), ("0", [0], [True]), ("|0/1", [0, 1], [True, False]), ("0|1/2", [0, 1, 2], [False, True, False])])
def test_genotypes(spark, gt, alleles, phased):
    assert one(spark, fields.genotype_alleles(F.lit(gt))) == alleles and one(spark, fields.genotype_phasing(F.lit(gt))) == phased


def test_samples_pair_as_far_as_both_go(spark):
    got = lambda f, s: [tuple(x) for x in one(spark, fields.sample_values(F.lit(f), F.lit(s)))]
    assert got("GT:DP:GQ", "0/1:.") == [("GT", "0/1"), ("DP", None)] and got("GT", "0:7:8") == [("GT", "0")]


def test_variant_ends(spark):
    end = lambda info, new=None: one(spark, fields.variant_end(F.lit(10).cast("bigint"), F.lit("ACG"), F.lit(info), new is None, new))
    assert end("DP=1") == 12 and end("END=40;END=50") == 40
    assert end("END=40;SVLEN=7,.", F.lit(5).cast("bigint")) == 16 and end("DP=1", F.lit(None).cast("bigint")) == 12


def test_attributes(spark):
    a = one(spark, fields.gff_attributes(F.lit("ID=a;Note=x%2Cy,p+q;ID=b;Bad=50%")))
    assert a == {"ID": ["a"], "Note": ["x,y", "p+q"], "Bad": ["50%"]}
    assert one(spark, fields.gff_text(fields.gff_attributes(F.lit("ID=a;Note=x%2Cy,z")))) == "ID=a;Note=x%2Cy,z"
    assert one(spark, fields.gff_attributes(F.lit("."))) == {}
    g = one(spark, fields.gtf_attributes(F.lit('gene_id "g"; t "";  x "1"; x "2"; level 3;')))
    assert g == {"gene_id": ["g"], "t": [""], "x": ["1", "2"], "level": ["3"]}
    assert one(spark, fields.gtf_unescape(F.lit(r"a\"b\\c"))) == r'a"b\c'
