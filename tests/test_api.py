"""Whole small runs, from files to tables, and streams."""

import random
import warnings

import pytest

from helixgrid.api import align, annotated_reads, make_fastq, metrics_dict, update_read
from helixgrid.operators.fragments import fragment_line
from helixgrid.plans.layout import Assay, LayoutError
from helixgrid.sources.alignments import write_counts
from helixgrid.sources.fastq import read_fastq
from helixgrid.streaming.running import fragment_qc_to, running_histogram
from tests.exact_aligner import Edited, ExactAligner

LAYOUT = """!Assay
assay_id: demo
modalities: [rna]
sequence_spec:
- !Read {read_id: R1, modality: rna, primer_id: p1, min_len: 12, max_len: 12, strand: pos, files: [!File {file_id: a, filetype: fastq, url: r1.fastq, urltype: local}]}
- !Read {read_id: R2, modality: rna, primer_id: p2, min_len: 20, max_len: 20, strand: neg, files: [!File {file_id: b, filetype: fastq, url: r2.fastq, urltype: local}]}
library_spec:
- !Region
  region_id: rna
  region_type: rna
  sequence_type: joined
  regions:
  - !Region {region_id: p1, region_type: truseq_read1, sequence_type: fixed, sequence: ACGT, min_len: 4, max_len: 4}
  - !Region {region_id: bc, region_type: barcode, sequence_type: onlist, sequence: NNNNNNNN, min_len: 8, max_len: 8, onlist: !Onlist {file_id: x, url: list.txt, urltype: local}}
  - !Region {region_id: umi, region_type: umi, sequence_type: random, sequence: NNNN, min_len: 4, max_len: 4}
  - !Region {region_id: cdna, region_type: cdna, sequence_type: random, sequence: X, min_len: 1, max_len: 100}
  - !Region {region_id: p2, region_type: truseq_read2, sequence_type: fixed, sequence: ACGT, min_len: 4, max_len: 4}
"""
TURN = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def run(tmp_path_factory):
    d, rng = tmp_path_factory.mktemp("run"), random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(2000))
    (d / "l.yaml").write_text(LAYOUT)
    (d / "list.txt").write_text("AAAACCCC\nGGGGTTTT\n")
    # (barcode, umi, place): one barcode with an error, one unknown.
    rows = [("AAAACCCC", "ACGT", 100)] * 3 + [("AAAACCCC", "ACGA", 105), ("AAAACCCG", "TTTT", 110), ("GGGGTTTT", "CCCC", 120), ("GGGGTTTT", "GAGA", 1500), ("CTCTCTCT", "CCCC", 100)]
    with open(d / "r1.fastq", "w") as a, open(d / "r2.fastq", "w") as b:
        for i, (bc, umi, at) in enumerate(rows):
            a.write(f"@n{i}/1\n{bc}{umi}\n+\n{'F' * 12}\n")
            b.write(f"@n{i}/2\n{genome[at : at + 20]}\n+\n{'F' * 20}\n")
    return d, genome


def test_gene_quantification(spark, run):
    d, genome = run
    tx = spark.createDataFrame([("T1", "G1", "one", "chr1", 90, 200, "+", [(90, 200)])], "transcript_id string, gene_id string, gene_name string, chrom string, start long, end long, strand string, exons array<struct<start:bigint,end:bigint>>")
    r = align(spark, Assay.load(str(d / "l.yaml")), ExactAligner({"chr1": genome}), "gene_quantification", transcripts=tx)
    # ACGA joins ACGT: cell A has ACGT and TTTT, cell G has CCCC.
    assert {(x.barcode, x.layer): x.value for x in r.output.collect()} == {("AAAACCCC", "X"): 2, ("AAAACCCC", "spliced"): 2, ("GGGGTTTT", "X"): 1, ("GGGGTTTT", "spliced"): 1}
    m = metrics_dict(r.metrics)
    assert m["barcode_bc"]["total"] == 8 and m["barcode_bc"]["mismatches"] == 2
    assert m["alignment"]["sequenced_reads"] == 8 and m["alignment"]["frac_valid_barcode"] == pytest.approx(7 / 8)
    assert {(x.barcode, x.linear, x.size) for x in r.coverage.collect()} == {("AAAACCCC", 100, 25), ("AAAACCCC", 110, 20), ("GGGGTTTT", 120, 20)}
    assert [(x.name, x.length, x.offset) for x in r.references.collect()] == [("chr1", 2000, 0)]
    write_counts(r.output, r.genes, str(d / "out"), r.coverage, r.references)
    assert {x.name: spark.read.parquet(str(x)).count() for x in (d / "out").iterdir()} == {"counts": 4, "genes": 1, "coverage": 3, "references": 1}
    assert m["gene"]["frac_intergenic"] == pytest.approx(1 / 7) and m["quantification"]["num_unique_umi"] == 3


def test_fragments(spark, run):
    """Single reads: their strand and their ends as they are; UMIs tell duplicates apart."""
    d, genome = run
    r = align(spark, Assay.load(str(d / "l.yaml")), ExactAligner({"chr1": genome}), "fragment")
    got = sorted((x.barcode, x.chrom, x.start, x.end, x["count"], x.strand) for x in r.output.collect())
    assert got == [("AAAACCCC", "chr1", 100, 120, 3, "+"), ("AAAACCCC", "chr1", 105, 125, 1, "+"), ("AAAACCCC", "chr1", 110, 130, 1, "+"), ("GGGGTTTT", "chr1", 120, 140, 1, "+"), ("GGGGTTTT", "chr1", 1500, 1520, 1, "+")]
    found = align(spark, Assay.load(str(d / "l.yaml")), ExactAligner({"chr1": genome}), "alignment").output
    assert found.count() == 8 and {"raw_barcode_qual", "umi_qual"} <= set(found.columns)
    with pytest.raises(ValueError):
        align(spark, Assay.load(str(d / "l.yaml")), ExactAligner({}), "nothing")


PAIRS = """!Assay
assay_id: pairs
modalities: [atac]
sequence_spec:
- !Read {read_id: R1, modality: atac, primer_id: p1, min_len: 28, max_len: 28, strand: pos, files: [!File {file_id: a, filetype: fastq, url: a.fastq, urltype: local}]}
- !Read {read_id: R2, modality: atac, primer_id: p2, min_len: 20, max_len: 20, strand: neg, files: [!File {file_id: b, filetype: fastq, url: b.fastq, urltype: local}]}
library_spec:
- !Region
  region_id: atac
  region_type: atac
  sequence_type: joined
  regions:
  - !Region {region_id: p1, region_type: truseq_read1, sequence_type: fixed, sequence: ACGT, min_len: 4, max_len: 4}
  - !Region {region_id: bc, region_type: barcode, sequence_type: random, sequence: NNNNNNNN, min_len: 8, max_len: 8}
  - !Region {region_id: gdna, region_type: gdna, sequence_type: random, sequence: X, min_len: 1, max_len: 100}
  - !Region {region_id: p2, region_type: truseq_read2, sequence_type: fixed, sequence: ACGT, min_len: 4, max_len: 4}
"""


def test_pairs(spark, tmp_path):
    """Mates go to the aligner together; duplicates, shifted ends, variants and cell calling without a list."""
    rng = random.Random(6)
    genome = "".join(rng.choice("ACGT") for _ in range(1000))
    (tmp_path / "l.yaml").write_text(PAIRS)
    rows = [("AAAACCCC", 100)] * 3 + [("AAAACCCC", 300)] * 12 + [("GGGGTTTT", 300)] * 25 + [("CACACACA", 300)] * 2 + [("CTCTCTCT", 300)]
    with open(tmp_path / "a.fastq", "w") as a, open(tmp_path / "b.fastq", "w") as b:
        for i, (bc, at) in enumerate(rows):
            a.write(f"@n{i}\n{bc}{genome[at : at + 20]}\n+\n{'F' * 28}\n")
            b.write(f"@n{i}\n{genome[at + 80 : at + 100].translate(TURN)[::-1]}\n+\n{'F' * 20}\n")
    assay = Assay.load(str(tmp_path / "l.yaml"))
    r = align(spark, assay, Edited({"chr1": genome}), "fragment", compute_snv=True)
    base = genome[105]
    got = {(x.barcode, x.start, x.end): (x["count"], x.strand, x.read_start1, x.snv1, x.read_start2, x.snv2) for x in r.output.collect()}
    want = {
        ("AAAACCCC", 104, 195): (3, None, 100, f"20:1;5{base}14:2", 180, "20"),
        ("AAAACCCC", 304, 395): (12, None, 300, "20", 380, "20"),
        ("GGGGTTTT", 304, 395): (25, None, 300, "20", 380, "20"),
        ("CACACACA", 304, 395): (2, None, 300, "20", 380, "20"),
    }  # the threshold is the first count below the called cells, 2, so that CTCTCTCT, seen once, goes
    assert got == want
    lines = [x.value for x in r.output.select(fragment_line(True).alias("value")).collect()]
    assert f"chr1\t104\t195\tAAAACCCC\t3\t.\t100\t20:1;5{base}14:2\t180\t20" in lines
    every = align(spark, assay, ExactAligner({"chr1": genome}), "fragment", call_cells=False).output
    assert every.count() == 5 and metrics_dict(r.metrics)["alignment"]["frac_properly_paired"] == 1.0


def test_update_read_infers_lengths(spark, run):
    d, _ = run
    assay = Assay.load(str(d / "l.yaml"))
    update_read(spark, assay, "R3", [str(d / "r1.fastq"), str(d / "r2.fastq")], modality="rna", primer_id="p1", is_reverse=False)
    assert (assay.reads["R3"].min_len, assay.reads["R3"].max_len) == (12, 20)
    update_read(spark, assay, "R2", min_len=15)
    assert (assay.reads["R2"].min_len, assay.reads["R2"].max_len) == (15, 20)


def test_update_read_is_verified(spark, run, tmp_path):
    """An unknown primer is refused and nothing changes; files that do not fit the lists give a warning; those that fit none."""
    d, _ = run
    assay = Assay.load(str(d / "l.yaml"))
    before = dict(assay.reads)
    for name in ("R1", "R9"):
        with pytest.raises(LayoutError):
            update_read(spark, assay, name, [str(d / "r1.fastq")], modality="rna", primer_id="nowhere", is_reverse=False)
    assert assay.reads == before and list(assay.reads) == ["R1", "R2"]
    (tmp_path / "odd.fastq").write_text("".join(f"@x{i}\n{'TCTCTCTCACGT'}\n+\n{'F' * 12}\n" for i in range(9)))
    with pytest.warns(UserWarning, match="R1: only 0% .* list of bc"):
        update_read(spark, assay, "R1", [str(tmp_path / "odd.fastq")])
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        update_read(spark, assay, "R1", [str(d / "r1.fastq")])


def test_layout_warning(spark, run, tmp_path):
    d, genome = run
    (tmp_path / "l.yaml").write_text(LAYOUT.replace("r1.fastq", str(d / "r1.fastq")).replace("r2.fastq", str(d / "r2.fastq")))
    (tmp_path / "list.txt").write_text("TTTTTTTT\nGGGGGGGG\n")
    with pytest.warns(UserWarning, match="have a barcode on the list of bc"):
        annotated_reads(spark, Assay.load(str(tmp_path / "l.yaml")))


def test_make_fastq(spark, run, tmp_path):
    d, genome = run
    make_fastq(spark, Assay.load(str(d / "l.yaml")), str(tmp_path), correct_barcode=True)
    got = {r.name: r.seq for r in read_fastq(spark, [str(p) for p in sorted((tmp_path / "R1").glob("part-*"))]).collect()}
    assert len(got) == 7 and got["n4"] == "AAAACCCCTTTT" + genome[110:130]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("A",), ("A",), ("C",)], "barcode string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = running_histogram(spark.readStream.schema("barcode string").parquet(str(tmp_path / "in")), "hist")
    q.processAllAvailable()
    q.stop()
    assert {(r.barcode, r.n) for r in spark.table("hist").collect()} == {("A", 2), ("C", 1)}
    schema = "chrom string, start long, end long, count long"
    spark.createDataFrame([("chr1", 0, 100, 2), ("chr1", 0, 200, 1)], schema).write.parquet(str(tmp_path / "frags"))
    q = fragment_qc_to(spark.readStream.schema(schema).parquet(str(tmp_path / "frags")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sum(r.num_unique_fragments for r in rows) == 2
