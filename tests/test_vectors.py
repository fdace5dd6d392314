"""Known small cases of splitting, variants, clipping, compatibility and helpers."""

import pytest
from pyspark.sql import functions as F

from helixgrid.functions import seq as S
from helixgrid.operators import barcodes as B
from helixgrid.operators import segments as M
from helixgrid.operators import snv as V
from helixgrid.operators import transcriptome as T
from helixgrid.operators.fragments import with_extents
from helixgrid.plans.layout import relative_path
from helixgrid.sources.fastq import strip_groups


def bc(n):
    return M.Element("b", "barcode", "onlist", "N" * n, n, n)


def umi(n):
    return M.Element("u", "umi", "random", "N" * n, n, n)


def cdna(a, b):
    return M.Element("c", "cdna", "random", "X", a, b)


def poly(a, b):
    return M.Element("p", "poly_a", "random", "X", a, b)


def var(a, b):
    return M.Element("v", "linker", "random", "X", a, b)


def linker(s):
    return M.Element("l", "linker", "fixed", s, len(s), len(s))


# Published cases of splitting, with the segments they must give.
SPLITS = [
    ("AAAAAA", [cdna(1, 5), linker("ATGT")], "[T]AAAAA"),
    ("AAAATTCCC", [bc(4), umi(2), cdna(2, 4), poly(2, 4)], "[B]AAAA,[U]TT,[T]CCC"),
    ("AATT", [bc(4), umi(2), cdna(2, 4), poly(2, 4)], "[B]AATT"),
    ("AATTGGT", [bc(4), umi(2), cdna(2, 4), poly(2, 4)], "[B]AATT,[U]GG"),
    ("AAAATTCCGGG", [bc(4), umi(2), cdna(2, 4), poly(2, 4)], "[B]AAAA,[U]TT,[TO]CCGGG"),
    ("AAAATTCCCCCCCGGGGGGGAAAATT", [bc(4), umi(2), cdna(2, 10), poly(2, 10), bc(4), umi(2)], "[B]AAAA,[U]TT,[TO]CCCCCCCGGGGGGGAAAATT"),
    ("AAAAATTACTGCCC", [bc(4), var(1, 3), umi(2), linker("ACTG")], "[B]AAAA,[O]A,[U]TT,[O]ACTG"),
    ("AAAAATTACCGGCCCACTGG", [bc(4), var(1, 3), umi(2), linker("ACTGG")], "[B]AAAA,[O]A,[U]TT,[O]ACCGG"),
    ("AAAAATTACCGGCCCACTG", [bc(4), var(1, 3), umi(2), linker("ACTGG"), cdna(10, 100)], "[B]AAAA,[O]A,[U]TT,[O]ACCGG"),
    ("AAAAATTACCGGCCCACTG", [bc(4), var(1, 3), umi(2), linker("ACTGG"), cdna(1, 100)], "[B]AAAA,[O]A,[U]TT,[O]ACCGG,[T]CCCACTG"),
    (
        "AAAAATTACCGGCCCAGGGGTTTTATGGGGACTGGGGGACTG",
        [bc(4), var(1, 3), umi(2), linker("ACTGG"), var(2, 4), bc(2), linker("GGGG"), var(2, 4), bc(2), linker("GGGG"), cdna(1, 100)],
        "[B]AAAA,[O]A,[U]TT,[O]ACCGG,[O]CC,[B]CA,[O]GGGG,[O]TTTT,[B]AT,[O]GGGG,[T]ACTGGGGGACTG",
    ),
]


def test_split(spark):
    parts = [M.split_reads(spark.createDataFrame([(i, seq, "F" * len(seq))], "id int, seq string, qual string"), layout, ["id"]) for i, (seq, layout, _) in enumerate(SPLITS)]
    got = {r.id: r.shown for p in parts for r in p.select("id", M.shown("segments").alias("shown")).collect()}
    assert [got[i] for i in range(len(SPLITS))] == [want for *_, want in SPLITS]


def test_split_edges(spark):
    """A reverse read, a linker that is checked, a read that ends within the anchor's reach, and no anchor at all."""
    one = lambda seq, layout, **how: M.split_reads(spark.createDataFrame([(1, seq, "F" * len(seq))], "id int, seq string, qual string"), layout, ["id"], **how).select("status", M.shown("segments").alias("s")).first()
    assert tuple(one("AAAACCGT", [bc(4), linker("ACGG")], linker_tolerance=0.0, reverse=True)) == ("ok", "[B]AAAA,[O]CCGT")
    assert tuple(one("AAAACCGA", [bc(4), linker("CCGT")], linker_tolerance=0.1)) == ("pattern_mismatch:1", None)
    assert tuple(one("AAAATTTTGG", [bc(4), var(1, 5), linker("ACTG")])) == ("ok", "[B]AAAA,[O]TTTTG")
    assert tuple(one("AAAATTTTGGGGGGGGG", [bc(4), var(1, 5), linker("ACTG")])) == ("pattern_mismatch:2", None)
    assert tuple(one("AAAATTTTTTTT", [bc(4), var(1, 2), linker("A")])) == ("anchor_not_found", None)
    assert tuple(one("AAAAGTTCAG", [bc(4), var(1, 3), linker("CTG"), cdna(1, 9)], reverse=True)) == ("ok", "[B]AAAA,[O]G,[O]TTC,[T]AG")


def test_split_over_rows(spark):
    reads = spark.createDataFrame([(1, "AAAAATTACTGCCC", "F" * 14), (2, None, None), (3, "AAAACCCCCCCCCCC", "F" * 15), (4, "", "")], "id int, seq string, qual string")
    out = {r.id: r for r in M.annotate(M.split_reads(reads, [bc(4), var(1, 3), umi(2), linker("ACTG")], ["id"])).collect()}
    assert (out[1].barcode, out[1].umi, out[1].status) == ("AAAA", "TT", "ok")
    assert out[2].segments is None and out[2].status == "no_sequence"
    assert out[3].status.startswith("pattern_mismatch")
    assert out[4].segments == [] and out[4].barcode is None


def test_truncated():
    layout = [bc(4), umi(2), cdna(2, 10)]
    assert [e.region_id for e in M.truncated(layout, 8)] == ["b", "u", "c"]
    assert [e.region_id for e in M.truncated(layout, 7)] == ["b", "u"]


# Published cases of variants, with the texts they must give.
SNVS = [
    (10003, "50M", "0A49", "CCCCTAACCCTAACCCTAACCCTAACCCTAACCCTAACCCTAACCCTAAC", "FFFF:FFFFF:FF:FF:FFFFFFFFFFFFFFFFF,FF:FF,FFFFFFFFF", "0C49"),
    (10004, "49M", "9T39", "CCCTAACCCAAACCCTAACCCTAACCCTAACCCTAACCCTAACCCTAAC", "FFFFFFFFF,FFFFF:FFFFFFF:FFFFFFFFF:FFFFFFFFFFFFFFF", "49"),
    (10009, "49M", "34T5T8", "ACCCTAACCCTAACCCTAACCCTAACCCTAACCCAAACCCAAACCCTAA", "F" * 49, "34A5A8"),
    (10010, "50M", "34A5A5A3", "CCCTAACCCTAACCCTAACCCTAACCCTAACCCTTACCCTTACCCTTACC", "F" * 50, "34T5T5T3"),
    (10010, "5M2I4M", "4A4", "CCCTGAACCCT", "F" * 11, "4G0+AA4"),
    (10010, "8M2I4M", "4A7", "CCCTGTTTAACCCT", "F" * 14, "4G3+AA4"),
    (10010, "5S8M2I4M", "4A7", "AAAAACCCTGTTTAACCCT", "F" * 19, "4G3+AA4"),
    (10010, "5H8M2I4M", "4A7", "CCCTGTTTAACCCT", "F" * 14, "4G3+AA4"),
    (10010, "23S61M14I1M14D52M", "61G0^GAGGGGGAGGGTGG52", "A" * 151, "F" * 151, "61+" + "A" * 14 + "0A0^" + "-" * 14 + "52"),
    (10010, "2M2D2M", "2^AA2", "CCCTGT", "FFFFFF", "2^--2"),
    (10010, "2M2D", "2^AA", "CCCT", "FFFFFF", "2^--"),
]


def test_variants(spark):
    rows = [(i, *x[:5]) for i, x in enumerate(SNVS)] + [(99, 1, "5M", "3^A1", "AAAAA", "FFFFF"), (100, 1, "5M", None, "AAAAA", "FFFFF")]
    out = {r.name: r for r in V.call_variants(spark.createDataFrame(rows, "name int, pos int, cigar string, md string, seq string, qual string")).collect()}
    assert [out[i].text for i in range(len(SNVS))] == [x[5] for x in SNVS]
    assert out[99].text is None and out[99].error and out[100].error == "missing field"


def test_md_tokens(spark):
    got = spark.range(1).select(S.md_tokens(F.lit("10A2^CTC3T")).alias("a"), S.md_tokens(F.lit("61G0^GAGGGGGAGGGTGG52")).alias("b")).first()
    assert got.a == ["10", "A", "2", "^CTC", "3", "T"] and got.b == ["61", "G", "0", "^GAGGGGGAGGGTGG", "52"]


def test_clip_extents(spark):
    r = with_extents(spark.createDataFrame([(10003, "4H50M2H"), (5, "10S"), (5, "3S2M")], "pos int, cigar string")).collect()
    assert (r[0].start, r[0].end, r[0].unclipped_start, r[0].unclipped_end) == (10003, 10052, 9999, 10054)
    assert r[1].unclipped_start == -5 and r[1].unclipped_end == r[1].end
    assert r[2].unclipped_start == 2


EXONS = [(10, 20), (30, 40), (50, 60), (500, 700), (1500, 1550), (5000, 6000)]
# The third case follows the rules as they are computed; see README.
COMPAT = [
    ([(12, 18), (32, 38)], "discordant"),
    ([(21, 29), (32, 38)], "discordant"),
    ([(5, 40), (50, 60), (500, 700), (1400, 1501)], "spanning"),
    ([(12, 20), (30, 38)], "exonic"),
    ([(6, 8)], "intronic"),
    ([(29, 38)], "spanning"),
    ([(5, 40), (50, 60), (500, 700), (1500, 1501)], "spanning"),
]


def test_compatibility(spark):
    kind = "array<struct<start:bigint,end:bigint>>"
    df = spark.createDataFrame([(s, EXONS) for s, _ in COMPAT], f"s {kind}, e {kind}")
    assert [r[0] for r in df.select(T.compatibility("s", "e")).collect()] == [k for _, k in COMPAT]


def test_within_ordmag(spark):
    counts = spark.createDataFrame([(x,) for x in (50, 60, 70, 80, 90, 100, 700, 800, 900, 1000)], "n long")
    ranks = spark.createDataFrame([(0,), (1,)], "idx long")
    assert {r.idx: r.within for r in B.within_ordmag(counts, ranks).collect()} == {0: 5, 1: 6}


def test_ordmag_bootstrap_is_fixed(spark):
    counts = spark.createDataFrame([(x,) for x in [1000] * 50 + [5] * 500], "n long")
    a, b = (B.ordmag_bootstrap(counts, samples=20) for _ in range(2))
    assert a == b and 5 <= a["threshold"] <= 1000
    assert B.ordmag_bootstrap(counts.limit(0)) == {"recovered": 0, "top_n": 0, "threshold": 0}
    assert B.ordmag_threshold(counts.limit(0)).count() == 0


@pytest.mark.parametrize("seq,want", [("AAAAAA", 6), ("ATCGTC", 1), ("CTCGAA", None), ("", None)])
def test_poly_prefix(spark, seq, want):
    assert spark.createDataFrame([(seq,)], "s string").select(S.poly_prefix("s", "A")).first()[0] == want


def test_regex_strip(spark):
    name = "A01535:24:HW2MMDSX2:2:1359:8513:3458:bd:69:Y6:10:TGATAGGTTG"
    rest, groups = strip_groups(F.col("n"), r"3458(:)(?<barcode>..:..:..:..)(:)(?<umi>[ATCG]+)$", 4)
    r = spark.createDataFrame([(name,), ("other",)], "n string").select(rest.alias("r"), *(g.alias(f"g{i}") for i, g in enumerate(groups))).collect()
    assert r[0].r == "A01535:24:HW2MMDSX2:2:1359:8513:3458" and r[0].g1 == "bd:69:Y6:10" and r[0].g3 == "TGATAGGTTG"
    assert r[1].r is None and r[1].g1 is None


def test_unique_barcodes(spark):
    got = [r[0] for r in spark.range(10).select(B.unique_barcode("id", 10)).collect()]
    assert got == ["AA", "AC", "AG", "AT", "CA", "CC", "CG", "CT", "GA", "GC"]


@pytest.mark.parametrize("to,want", [("/a/b/d/e", "../d/e"), ("/a/b/c/d", "d"), ("/a/b/c/d/e", "d/e"), ("/a/b", ".."), ("/a", "../.."), ("/a/b/c", "")])
def test_relative_path(to, want):
    assert relative_path("/a/b/c", to) == want


def test_small_functions(spark):
    r = spark.range(1).select(
        S.revcomp(F.lit("ACgt")).alias("rc"), S.revcomp(F.lit("ACgt"), False).alias("rc2"), S.complement_keeping_case(F.lit("Ac")).alias("k"), S.hamming(F.lit("ACG"), F.lit("ATG")).alias("h"),
        S.hamming(F.lit("ACG"), F.lit("AT")).alias("h0"), S.strip_mate_suffix(F.lit("x/1")).alias("m"), S.strip_mate_suffix(F.lit("/1")).alias("m2"), S.q30_bases(F.lit("?>F,")).alias("q"),
        F.round(S.expected_errors(F.lit("+5")), 4).alias("e"), S.best_match(F.lit("GGACTT"), "AGT").alias("b"), S.best_match(F.lit("GG"), "A").alias("one"),
    ).first()
    assert (r.rc, r.rc2, r.k, r.h, r.h0, r.m, r.m2, r.q, r.e) == ("ACGT", "tgGT", "Tg", 1, None, "x", "/1", 2, 0.11)
    assert (r.b.pos, r.b.mismatches) == (2, 1) and (r.one.pos, r.one.mismatches) == (None, 1)
