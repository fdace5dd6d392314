import hashlib

import pytest

from helixgrid import utils as U
from helixgrid.sources.fastq import read_fastq


def _write(path, names, seq="ACGT"):
    path.write_text("".join(f"@{n}\n{seq}\n+\n{'F' * len(seq)}\n" for n in names))


def _parts(path):
    return [str(p) for p in sorted(path.glob("part-*"))]


def test_strip_barcode_from_fastq(spark, tmp_path):
    _write(tmp_path / "a.fastq", ["run:7:ACGT:TT x", "run:8:GGGG:CC"])
    U.strip_barcode_from_fastq(spark, str(tmp_path / "a.fastq"), str(tmp_path / "out"), r"(:)([ACGT]{4})(:)([ACGT]{2})$", {"barcode": 2, "umi": 4}, 4)
    got = {k: [(r.name, r.seq) for r in read_fastq(spark, _parts(tmp_path / "out" / k)).orderBy("rec_idx").collect()] for k in ("reads", "barcode", "umi")}
    assert got == {"reads": [("run:7", "ACGT"), ("run:8", "ACGT")], "barcode": [("run:7", "ACGT"), ("run:8", "GGGG")], "umi": [("run:7", "TT"), ("run:8", "CC")]}
    with pytest.raises(Exception, match="no match"):
        U.strip_barcodes(read_fastq(spark, str(tmp_path / "a.fastq")), "(zzz)$", {"b": 1}, 1).collect()


def test_extract_barcode_from_name(spark, tmp_path):
    _write(tmp_path / "a.fastq", ["r1_ACGT desc", "r2_TTTT"])
    rows = U.extract_barcode_from_name(read_fastq(spark, str(tmp_path / "a.fastq")), lambda s: s.split("_")[0], lambda s: s.split("_")[1][:4]).orderBy("rec_idx").collect()
    assert [(r.name, r.barcode) for r in rows] == [("r1", "ACGT"), ("r2", "TTTT")]


def test_multiplex_fastq(spark, tmp_path):
    for k in range(5):
        _write(tmp_path / f"{k}.fastq", [f"f{k}r{i}" for i in range(2)])
    U.multiplex_fastq(spark, [str(tmp_path / f"{k}.fastq") for k in range(5)], None, str(tmp_path / "out"))
    rows = read_fastq(spark, _parts(tmp_path / "out" / "I1")).orderBy("rec_idx").collect()
    assert [(r.name, r.seq) for r in rows] == [(f"f{k}r{i}", b) for k, b in enumerate(["AA", "AC", "AG", "AT", "CA"]) for i in range(2)]


def test_sam_to_fastq_and_md5(spark, tmp_path):
    (tmp_path / "x.sam").write_text("r\t83\tchr1\t5\t60\t4M\t=\t1\t0\tACGG\tABCD\tCR:Z:AAAT\nr\t163\tchr1\t1\t60\t4M\t=\t5\t0\tTTTT\tFFFF\n")
    U.sam_to_fastq(spark, str(tmp_path / "x.sam"), str(tmp_path / "out"))
    got = {k: [(r.seq, r.qual) for r in read_fastq(spark, _parts(tmp_path / "out" / k)).collect()] for k in ("R1", "R2", "I1")}
    assert got == {"R1": [("CCGT", "DCBA")], "R2": [("TTTT", "FFFF")], "I1": [("AAAT", "~~~~")]}
    assert U.file_md5(spark, str(tmp_path / "x.sam")) == {"x.sam": hashlib.md5((tmp_path / "x.sam").read_bytes()).hexdigest()}
