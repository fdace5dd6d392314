"""BAM files: round trips against SAM text, every split, odd records, commits."""

import random
import struct

import pytest

from helixgrid.sources import alignments as A
from helixgrid.sources import bam as B
from helixgrid.sources import containers as C
from helixgrid.sources.parts import END_BLOCK, block

REFS = [("chr1", 100_000), ("chr2", 5_000), ("chrM", 90)]
SCHEMA = "name string, flags int, chrom string, pos long, mapq int, cigar string, seq string, qual string, md string, barcode string, raw_barcode string, umi string, mate_chrom string"


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        m = rng.randint(0, 60)
        mapped = rng.random() < 0.8
        seq = "".join(rng.choice("ACGTN") for _ in range(m)) or None
        qual = None if seq is None or rng.random() < 0.2 else "".join(chr(33 + rng.randrange(60)) for _ in range(m))
        cigar = f"{m}M" if m and mapped and rng.random() < 0.7 else (f"2S{m}M3I1D7N" if mapped and m else None)
        tag = lambda: rng.choice([None, "ACGT-1", ""])
        out.append((f"r{i}", rng.randrange(4096), f"chr{rng.choice('12M')}" if mapped else None, rng.randrange(1, 90) if mapped else 0, rng.choice([None, 0, 60]), cigar, seq, qual, rng.choice([None, "5A5"]), tag(), tag(), rng.choice([None, "TTT"]), rng.choice([None, "chr1", "chrM"])))
    return out


COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def test_round_trip_over_many_ranges(spark, tmp_path):
    data = rows(6000)
    df = spark.createDataFrame(data, SCHEMA).coalesce(1)
    B.write_bam(df, str(tmp_path / "b"), REFS)
    for range_bytes in (3_000, 20_000, 1 << 26):
        back = B.read_bam(spark, str(tmp_path / "b"), range_bytes)
        assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
        got = back.select("rec_idx", *COLUMNS).collect()
        assert [tuple(r)[1:] for r in got] == data and [r.rec_idx for r in got] == list(range(6000))
    assert [tuple(r) for r in B.bam_chrom_sizes(spark, str(tmp_path / "b")).collect()] == [(i, *r) for i, r in enumerate(REFS)]


def test_equals_the_text_path(spark, tmp_path):
    df = spark.createDataFrame([r[:12] + (None,) for r in rows(500, 2) if "" not in r], SCHEMA)
    A.write_alignments(df, str(tmp_path / "sam"), as_text=True)
    B.write_bam(df.repartition(3), str(tmp_path / "bam"), REFS)
    text, binary = A.read_sam(spark, str(tmp_path / "sam")), B.read_bam(spark, str(tmp_path / "bam"))
    columns = [c for c in text.columns]
    assert sorted(map(str, text.select(columns).collect())) == sorted(map(str, binary.select(columns).collect()))


def test_every_split(tmp_path, monkeypatch):
    """Records that cross blocks, and blocks that cross ranges, at each size of a range."""
    monkeypatch.setattr(C, "CHUNK", 64)
    monkeypatch.setattr(C, "PROOF", 64)

    class Row(dict):
        asDict = dict.copy

    data = [dict(zip(COLUMNS, r, strict=True)) for r in rows(40, 3)]
    raw = B.header_bytes(REFS) + b"".join(B.encode(Row(r), {n: i for i, (n, _) in enumerate(REFS)}) for r in data)
    packed = b"".join(block(raw[a : a + 97]) for a in range(0, len(raw), 97)) + END_BLOCK
    (tmp_path / "x.bam").write_bytes(packed)
    path = str(tmp_path / "x.bam")
    _, refs, header = B.read_header(path)
    assert refs == REFS
    for range_bytes in (1, 50, 97, 150, 333, 1000, 100_000):
        ranges = C.chained(C.ranges_of([(0, path, len(packed))], range_bytes), lambda some: [B._counted(B.Records(r, header, 3), r) for r in some])
        names = []
        for r in ranges:
            for held, places in B.Records(r, header, 3).batches():
                names += [held[p + 36 : p + 36 + held[p + 12] - 1].decode() for p in places]
        assert names == [r["name"] for r in data], range_bytes


def test_long_records_tags_and_bins(spark, tmp_path):
    many = "".join("1M1I" for _ in range(40_000))
    df = spark.createDataFrame([("long", 0, "chr1", 5, 60, many, "AC" * 40_000, None), ("lower", 4, None, 0, None, None, "acgtn", "IIIII")], "name string, flags int, chrom string, pos long, mapq int, cigar string, seq string, qual string")
    B.write_bam(df.coalesce(1), str(tmp_path / "b"), REFS)
    got = B.read_bam(spark, str(tmp_path / "b"), 200).orderBy("rec_idx").collect()
    assert (got[0].cigar, got[0].seq, got[0].qual, got[1].seq, got[1].qual) == (many, "AC" * 40_000, None, "ACGTN", "IIIII")
    raw = b"NHC\x05" + b"XBBS" + struct.pack("<I2H", 2, 7, 8) + b"CBZab\0" + b"XAAq" + b"MDZ3\0"
    assert B._tags(raw, 0, len(raw)) == {"CB": "ab", "MD": "3"}
    # Bins of the format: the smallest that holds an interval.
    assert [B._bin(a, b) for a, b in ((0, 1), (16383, 16385), (0, 1 << 29), (1 << 26, (1 << 26) + 1))] == [4681, 585, 0, 4681 + (1 << 12)]


def test_empty_broken_and_repeated_writes(spark, tmp_path):
    df = spark.createDataFrame(rows(10), SCHEMA)
    B.write_bam(df.limit(0), str(tmp_path / "e"), REFS)
    assert B.read_bam(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(Exception, match="KeyError|chr1"):
        B.write_bam(df, str(tmp_path / "bad"), [("other", 5)])
    assert not list((tmp_path / "bad").glob("part-*")) if (tmp_path / "bad").exists() else True
    for overwrite, n in ((False, 10), (False, 20), (True, 10)):
        B.write_bam(df, str(tmp_path / "twice"), REFS, overwrite=overwrite)
        assert B.read_bam(spark, str(tmp_path / "twice")).count() == n
    part = next((tmp_path / "twice").glob("part-*.bam"))
    part.write_bytes(part.read_bytes()[:-60])
    with pytest.raises(Exception, match="ends within"):
        B.read_bam(spark, str(part)).collect()
    (tmp_path / "no.bam").write_bytes(block(b"something else entirely"))
    with pytest.raises(ValueError, match="no BAM"):
        B.read_bam(spark, str(tmp_path / "no.bam"))


def test_encoding_a_record_parses_a_cigar_once():
    from pyspark.sql import Row

    from helixgrid.sources import bam

    row = Row(name="r", flags=0, chrom="a", pos=5, cigar="3M1D2S", seq="acgTN", qual="!I~FF")
    bam._packed_cigar.cache_clear()
    one, two = (bam.encode(row, {"a": 0}) for _ in range(2))
    assert one == two and bam._packed_cigar.cache_info()[:2] == (1, 1)
    assert bytes([0x12, 0x48, 0xF0]) + bytes([0, 40, 93, 37, 37]) in one
