"""Options of align through whole runs: several assays, places that may differ, expected errors, strandedness; and genes of
reads with several alignments."""

import random

import pytest

from helixgrid.api import align
from helixgrid.operators.transcriptome import resolve_single
from helixgrid.plans.layout import Assay
from tests.exact_aligner import ExactAligner
from tests.test_api import LAYOUT

TX = "transcript_id string, gene_id string, gene_name string, chrom string, start long, end long, strand string, exons array<struct<start:bigint,end:bigint>>"


@pytest.fixture(scope="module")
def two(tmp_path_factory):
    """Two assays of one genome; of the second one, a barcode with two errors and one of low quality."""
    rng = random.Random(9)
    genome = "".join(rng.choice("ACGT") for _ in range(1000))
    sets = {"a": [("AAAACCCC", 100, "F"), ("AAAACCCC", 100, "F"), ("GGGGTTTT", 120, "F")], "b": [("AAAACCCC", 100, "F"), ("AAAACCGG", 300, "F"), ("GGGGTTTT", 400, "#")]}
    found = []
    for name, rows in sets.items():
        d = tmp_path_factory.mktemp(name)
        (d / "l.yaml").write_text(LAYOUT)
        (d / "list.txt").write_text("AAAACCCC\nGGGGTTTT\n")
        with open(d / "r1.fastq", "w") as a, open(d / "r2.fastq", "w") as b:
            for i, (bc, at, q) in enumerate(rows):
                a.write(f"@{name}{i}/1\n{bc}ACGT\n+\n{q * 8}FFFF\n")
                b.write(f"@{name}{i}/2\n{genome[at : at + 20]}\n+\n{'F' * 20}\n")
        found.append(Assay.load(str(d / "l.yaml")))
    return found, genome


def fragments(spark, two, **options):
    assays, genome = two
    out = align(spark, assays, ExactAligner({"chr1": genome}), "fragment", verify=False, **options).output
    return sorted((x.barcode, x.start, x["count"]) for x in out.collect())


def test_several_assays_are_one_run(spark, two):
    """Duplicates are told across assays."""
    assert fragments(spark, two) == [("AAAACCCC", 100, 3), ("GGGGTTTT", 120, 1), ("GGGGTTTT", 400, 1)]


def test_two_places_may_differ(spark, two):
    assert fragments(spark, two, mismatch=2) == [("AAAACCCC", 100, 3), ("AAAACCCC", 300, 1), ("GGGGTTTT", 120, 1), ("GGGGTTTT", 400, 1)]


def test_barcodes_of_many_expected_errors_are_none(spark, two):
    assert fragments(spark, two, max_expected_errors=1.0) == [("AAAACCCC", 100, 3), ("GGGGTTTT", 120, 1)]


def test_strandedness_that_is_given(spark, two):
    assays, genome = two

    def counted(strand, strandedness):
        tx = spark.createDataFrame([("T1", "G1", "one", "chr1", 90, 200, strand, [(90, 200)])], TX)
        r = align(spark, assays[0], ExactAligner({"chr1": genome}), "gene_quantification", transcripts=tx, strandedness=strandedness, verify=False)
        return {(x.barcode, x.layer): x.value for x in r.output.collect()}

    whole = counted("+", "forward")
    assert whole[("AAAACCCC", "X")] == 1 and whole[("GGGGTTTT", "X")] == 1
    assert counted("-", "reverse") == whole and counted("+", "reverse") == {} == counted("-", "forward")


def test_flags_of_the_first_alignment_that_has_a_good_hit(spark):
    """Plain rule over all small combinations of three hits on two alignments of one gene."""
    kinds = ("exonic", "intronic", "spanning", "discordant")
    rows, want = [], {}
    for n, (x, y, z, anti) in enumerate((x, y, z, anti) for x in kinds for y in kinds for z in kinds for anti in (False, True)):
        hits = [(n, 0, "A", "G", x, anti), (n, 1, "A", "G", y, False), (n, 1, "B", "G", z, False)]
        rows += hits
        good = [h for h in hits if not h[5] and h[4] != "discordant"]
        first = [h[4] for h in good if h[1] == min(g[1] for g in good)]
        want[n] = ("aligned" if good else "discordant", *((all(k == "exonic" for k in first), all(k == "intronic" for k in first), "spanning" in first and "exonic" not in first) if good else (False,) * 3), sorted(first))
    hits = spark.createDataFrame(rows, "read_id long, aln_idx int, transcript_id string, gene_id string, align_type string, antisense boolean")
    out = resolve_single(hits.select("read_id", "aln_idx"), hits).collect()
    assert {r.read_id: (r.kind, r.exonic_only, r.intronic_only, r.spanning, sorted(h.align_type for h in r.hits)) for r in out} == want
