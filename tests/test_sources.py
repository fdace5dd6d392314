"""FASTQ, SAM, GTF and fragment files, layouts, and a whole small run."""

import gzip

import pytest
import zstandard
from pyspark.sql import functions as F

from helixgrid.operators.aligner import align_reads, is_fasta
from helixgrid.plans.layout import Assay, LayoutError, parse_region_type
from helixgrid.sources import alignments as A
from helixgrid.sources import fastq as Q
from tests.exact_aligner import ExactAligner

LAYOUT = """!Assay
assay_id: demo
name: demo
modalities: [RNA]
sequence_spec:
- !Read {read_id: R1, modality: rna, primer_id: p1, min_len: 8, max_len: 8, strand: pos}
- !Read {read_id: R2, modality: rna, primer_id: p2, min_len: 6, max_len: 10, strand: neg}
library_spec:
- !Region
  region_id: rna
  region_type: RNA
  sequence_type: joined
  regions:
  - !Region {region_id: p5, region_type: illumina_p5, sequence_type: fixed, sequence: ACGT, min_len: 4, max_len: 4}
  - !Region {region_id: i5, region_type: index5, sequence_type: random, sequence: NNNN, min_len: 4, max_len: 4}
  - !Region {region_id: p1, region_type: TruSeq_Read1, sequence_type: fixed, sequence: ACGT, min_len: 4, max_len: 4}
  - !Region {region_id: bc, region_type: BARCODE, sequence_type: onlist, sequence: NNNN, min_len: 4, max_len: 4, onlist: !Onlist {file_id: x, url: list.txt, urltype: local, md5: 0}}
  - !Region {region_id: umi, region_type: umi, sequence_type: random, sequence: NN, min_len: 2, max_len: 2}
  - !Region {region_id: cdna, region_type: cdna, sequence_type: random, sequence: X, min_len: 1, max_len: 100}
  - !Region {region_id: p2, region_type: truseq_read2, sequence_type: fixed, sequence: ACGT, min_len: 4, max_len: 4, parent_id: rna}
  - !Region {region_id: i7, region_type: index7, sequence_type: random, sequence: NNNNNN, min_len: 6, max_len: 6}
  - !Region {region_id: p7, region_type: illumina_p7, sequence_type: fixed, sequence: ACGT, min_len: 4, max_len: 4}
"""


def _fastq(path, records, opener=open):
    with opener(path, "wt") as f:
        for name, seq in records:
            f.write(f"@{name}\n{seq}\n+\n{'F' * len(seq)}\n")


def test_read_fastq_files_in_order(spark, tmp_path):
    first = [(f"a{i} x y", "ACGT" * (i % 3 + 1)) for i in range(500)]
    second = [(f"b{i}", "GG") for i in range(7)]
    _fastq(tmp_path / "z.fastq", first)
    _fastq(tmp_path / "a.fastq.gz", second, gzip.open)
    third = [("c0", "T"), ("c1", "TT")]
    _fastq(tmp_path / "c.fastq", third)
    (tmp_path / "m.fastq.zst").write_bytes(zstandard.compress((tmp_path / "c.fastq").read_bytes()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # records that cross splits
    try:
        got = Q.read_fastq(spark, [str(tmp_path / "z.fastq"), str(tmp_path / "a.fastq.gz"), str(tmp_path / "m.fastq.zst")], max_len=6).orderBy("rec_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.rec_idx for r in got] == list(range(509)) and [r.name for r in got] == [n.split()[0] for n, _ in first + second + third]
    assert [r.seq for r in got] == [s[:6] for _, s in first + second + third] and got[0].descr == "x y" and got[-1].descr == ""
    assert Q.read_fastq(spark, []).count() == 0


def test_broken_fastq_fails(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("@a\nACGT\n+\nFF\n")
    with pytest.raises(Exception, match="broken record"):
        Q.read_fastq(spark, str(tmp_path / "x.fastq")).collect()


def test_lockstep(spark, tmp_path):
    _fastq(tmp_path / "1.fastq", [("r1/1", "AC"), ("r2/1", "GG")])
    _fastq(tmp_path / "2.fastq", [("r1/2", "TT"), ("r2/2", "CC")])
    _fastq(tmp_path / "3.fastq", [("r1/2", "TT")])
    r = {k: Q.read_fastq(spark, str(tmp_path / f"{k}.fastq")) for k in "123"}
    rows = Q.lockstep({"R1": r["1"], "R2": r["2"]}).orderBy("rec_idx").collect()
    assert [(x.name, x.R1.seq, x.R2.seq) for x in rows] == [("r1", "AC", "TT"), ("r2", "GG", "CC")]
    with pytest.raises(Exception, match="do not belong together"):
        Q.lockstep({"R1": r["1"], "R3": r["3"]}).collect()


def test_write_and_consolidate(spark, tmp_path):
    q = "struct<seq:string,qual:string>"
    reads = spark.createDataFrame([("n", "ACGT", "FFFF", "ACGA", "TT", "FF", ("GG", "FF"), None), ("m", "AAAA", "FFFF", None, None, None, ("C", "F"), ("T", "F"))], f"name string, barcode string, barcode_qual string, corrected string, umi string, umi_qual string, r1 {q}, r2 {q}")
    assert {(r.name, r.seq1, r.seq2) for r in Q.consolidated(reads).collect()} == {("n", "ACGATTGG", None), ("m", "AAAAC", "T")}
    kept = Q.consolidated(reads, corrected=True)
    assert [r.name for r in kept.collect()] == ["n"]
    Q.write_fastq(kept, str(tmp_path / "out"), "name", "seq1", "qual1", order=None)
    back = Q.read_fastq(spark, [str(p) for p in sorted((tmp_path / "out").glob("part-*"))]).first()
    assert (back.name, back.seq, back.qual) == ("n", "ACGATTGG", "FFFFFFFF")


def test_sam_and_gtf(spark, tmp_path):
    sam = ["@SQ\tSN:chr1\tLN:100", "@SQ\tSN:chr2\tLN:50", "r/1\t83\tchr1\t5\t255\t4M\t=\t1\t0\tACGG\tABCD\tMD:Z:4\tCB:Z:AAAA\tCR:Z:AAAT", "r/2\t163\tchr1\t1\t60\t4M\t=\t5\t0\tTTTT\tFFFF\tMD:Z:4", "r/2\t419\tchr2\t1\t0\t4M\t=\t5\t0\t*\t*"]
    (tmp_path / "x.sam").write_text("\n".join(sam) + "\n")
    x = A.read_sam(spark, str(tmp_path / "x.sam"))
    assert [(r.name, r.length) for r in A.read_chrom_sizes(spark, str(tmp_path / "x.sam")).orderBy("ord").collect()] == [("chr1", 100), ("chr2", 50)]
    m = {(r.mate, r.chrom): (r.aln_idx, r.is_multi) for r in A.multimaps(x).collect()}
    assert m == {(1, "chr1"): (0, False), (2, "chr1"): (0, True), (2, "chr2"): (1, True)}
    f = A.alignments_to_fastq(x).first()
    assert (f.r1.seq, f.r1.qual, f.r2.seq, f["index"].seq, f["index"].qual) == ("CCGT", "DCBA", "TTTT", "AAAT", "~~~~")
    A.write_alignments(x, str(tmp_path / "sam"), as_text=True)
    again = A.read_sam(spark, str(tmp_path / "sam"))
    assert {(r.name, r.flags, r.mapq, r.barcode) for r in again.collect()} == {(r.name, r.flags, r.mapq, r.barcode) for r in x.collect()}
    gtf = ['chr1\tx\texon\t11\t20\t.\t+\t.\tgene_id "G"; transcript_id "T"; gene_name "N";', 'chr1\tx\texon\t1\t5\t.\t+\t.\tgene_id "G"; transcript_id "T";', "# c"]
    (tmp_path / "x.gtf").write_text("\n".join(gtf) + "\n")
    t = A.read_gtf(spark, str(tmp_path / "x.gtf")).first()
    assert (t.start, t.end, [tuple(e) for e in t.exons], t.gene_name) == (0, 20, [(0, 5), (10, 20)], "N")


def test_fragment_files(spark, tmp_path):
    f = spark.createDataFrame([("chr1", 1, 9, "A", 2, None), ("chr1", 0, 5, None, 1, "+")], "chrom string, start long, end long, barcode string, count long, strand string")
    A.write_fragments(f, str(tmp_path / "f"), {"id": "x"})
    assert {tuple(r) for r in A.read_fragments(spark, str(tmp_path / "f")).collect()} == {tuple(r) for r in f.collect()}
    lines = spark.createDataFrame([("# c",), ("chr1\t1\t2",), ("chr2\t3\t4\t.\t.\t.\textra",)], "value string")
    assert {tuple(r) for r in A.parse_fragments(lines).collect()} == {("chr1", 1, 2, None, 1, None), ("chr2", 3, 4, None, 1, None)}


def test_exact_aligner(spark):
    reads = spark.createDataFrame([("a", "ACGTT", "ABCDE", None, None), ("b", "AACGT", "ABCDE", None, None), ("c", "GGGGG", "ABCDE", None, None), ("d", "ACGTT", "ABCDE", "GGAAC", "EDCBA")], "name string, seq1 string, qual1 string, seq2 string, qual2 string")
    rows = align_reads(reads, ExactAligner({"chr1": "TTACGTTCC"})).collect()
    got = {r.name: r for r in rows if r.mate is None}
    assert [(r.mate, r.flags, r.pos) for r in rows if r.name == "d"] == [(1, 67, 3), (2, 147, 5)]
    assert (got["a"].pos, got["a"].flags & 16, got["b"].pos, got["b"].flags & 16, got["b"].qual, got["c"].flags) == (3, 0, 3, 16, "EDCBA", 4)
    assert is_fasta("x.fa.gz") and not is_fasta("x.fastq")


def test_layout(tmp_path):
    (tmp_path / "l.yaml").write_text(LAYOUT)
    a = Assay.load(str(tmp_path / "l.yaml"))
    assert a.modality() == "rna" and [e.region_id for e in a.segments("R1")] == ["bc", "umi", "cdna"] and [e.region_id for e in a.segments("R2")] == ["cdna"]
    assert a.onlists("rna")["bc"].url == str(tmp_path / "list.txt") and a.onlists("rna")["bc"].md5 == "0"
    again = Assay.parse(a.to_yaml())
    assert [r.raw() for r in again.library] == [r.raw() for r in a.library] and again.reads == a.reads
    assert "url: list.txt" in a.to_yaml(str(tmp_path))
    a.add_illumina_reads("RNA", 50, forward_strand_workflow=True)
    assert {k: (r.primer_id, r.strand, r.max_len) for k, r in a.reads.items()} == {"rna-R1": ("p1", "pos", 50), "rna-I2": ("p5", "pos", 4), "rna-R2": ("p2", "neg", 50), "rna-I1": ("p2", "pos", 6)}
    a.add_illumina_reads("rna", 50)
    assert (a.reads["rna-I2"].primer_id, a.reads["rna-I2"].strand) == ("p1", "neg")
    assert "bc (barcode, 4)" in repr(a)
    a.delete_region("umi")
    assert a.region("umi") is None and a.parent("bc").region_id == "rna"
    with pytest.raises(LayoutError):
        a.update_read("new")
    assert a.update_read("new", modality="rna", primer_id="bc", is_reverse=False)  # warns: not a primer


def test_illumina_reads_of_partial_libraries():
    """Without P7 there is no second read; an index read stops before the fixed sequences next to the adapter."""
    spacer = "  - !Region {region_id: s%d, region_type: linker, sequence_type: fixed, sequence: AC, min_len: 2, max_len: 2}\n"
    lines = LAYOUT.splitlines(keepends=True)
    at = next(i for i, x in enumerate(lines) if "region_id: i5" in x)
    padded = "".join([*lines[:at], spacer % 1, lines[at], spacer % 2, *lines[at + 1 :]])
    a = Assay.parse(padded)
    a.add_illumina_reads("rna", 50, forward_strand_workflow=True)
    assert a.reads["rna-I2"].max_len == 6  # the spacer next to P5 and the index
    a.add_illumina_reads("rna", 50)
    assert a.reads["rna-I2"].max_len == 6  # the spacer next to the primer and the index
    b = Assay.parse(LAYOUT.replace("illumina_p7", "linker"))
    b.add_illumina_reads("rna")
    assert set(b.reads) == {"rna-R1", "rna-I2"} and b.reads["rna-R1"].max_len == 150
    c = Assay.parse(LAYOUT.replace("illumina_p5", "linker"))
    c.add_illumina_reads("rna")
    assert set(c.reads) == {"rna-R2", "rna-I1"}


def test_layout_rules():
    assert parse_region_type("PolyA") == "poly_a" and parse_region_type("TruSeq_Read1") == "truseq_read1"
    with pytest.raises(LayoutError):
        parse_region_type("nothing")
    for bad in (LAYOUT.replace("region_id: umi", "region_id: bc"), LAYOUT.replace("read_id: R2", "read_id: R1"), LAYOUT.replace("region_type: RNA", "region_type: barcode")):
        with pytest.raises(LayoutError):
            Assay.parse(bad)
    deep = "!Assay\nlibrary_spec:\n- !Region {region_id: a, region_type: rna, regions: [!Region {region_id: b, region_type: umi, regions: [!Region {region_id: c, region_type: umi}]}]}"
    with pytest.raises(LayoutError):
        Assay.parse(deep)


def test_read_fastq_odd_paths(spark, tmp_path):
    """Spaces and signs in names, a file given twice, gzip data under another name, a folder, and an empty file."""
    import gzip

    names = ["a b.fastq", "c%20d.fastq", "e#f+g.fastq", "same.fastq"]
    for i, n in enumerate(names):
        (tmp_path / n).write_text("".join(f"@r{i}{k}\nACG{'ACGT'[k]}\n+\nFFFF\n" for k in range(3)))
    (tmp_path / "packed").write_bytes(gzip.compress(b"@z\nAC\n+\nFF\n"))
    (tmp_path / "empty.fastq").write_text("")
    (tmp_path / "dir").mkdir()
    (tmp_path / "dir" / "same.fastq").write_text("@d\nA\n+\nF\n")
    paths = [str(tmp_path / n) for n in ["same.fastq", "a b.fastq", "empty.fastq", "same.fastq", "c%20d.fastq", "packed", "e#f+g.fastq", "dir"]]
    rows = Q.read_fastq(spark, paths).orderBy("rec_idx").collect()
    assert [r.rec_idx for r in rows] == list(range(17))
    assert [r.file_idx for r in rows] == [0] * 3 + [1] * 3 + [3] * 3 + [4] * 3 + [5] + [6] * 3 + [7]
    assert [r.name for r in rows] == ["r30", "r31", "r32", "r00", "r01", "r02", "r30", "r31", "r32", "r10", "r11", "r12", "z", "r20", "r21", "r22", "d"]
    with pytest.raises(FileNotFoundError):
        Q.read_fastq(spark, str(tmp_path / "missing.fastq"))


def test_groups_by_name_and_within_groups(spark):
    x = spark.createDataFrame([("AB12cdXY",), ("zz",)], "t string")
    rest, (code, kind) = Q.strip_groups(F.col("t"), r"^AB(?<kind>(?<digit>\d)\d)cd(?<code>[A-Z]+)$", ["code", "kind"])
    rows = x.select(rest.alias("r"), code.alias("c"), kind.alias("k")).collect()
    assert tuple(rows[0]) == ("ABcd", "XY", "12") and tuple(rows[1]) == (None, None, None)
    assert Q.group_names(r"(?<a>x)(y)(?<b>z)") == {"a": 1, "b": 3}
