"""FASTQ by byte ranges: every split, container and odd record against the records that were written."""

import gzip
import random
import struct
import zlib

import pytest
import zstandard

from helixgrid.sources import containers as C
from helixgrid.sources import fastq as Q
from helixgrid.sources import fastq_scan as S


def bgzf(raw, size):
    out = b""
    for part in [*(raw[a : a + size] for a in range(0, len(raw), size)), b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(data) + 25) + data + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def pieces(raw, size, pack):
    return b"".join(pack(raw[a : a + size]) for a in range(0, len(raw), size))


WAYS = {
    "plain": lambda x: x,
    "bgzf": lambda x: bgzf(x, 37),
    "members": lambda x: pieces(x, 101, gzip.compress),
    "frames": lambda x: pieces(x, 50, zstandard.compress),
    "gzip": gzip.compress,
    "zstd": zstandard.compress,
}


def record(rng, i):
    n = rng.randint(0, 12)
    head = f"@r{i}" + rng.choice(["", " x", "@y @z"])
    return head.encode(), "".join(rng.choice("ACGT") for _ in range(n)).encode(), rng.choice([b"+", b"+" + head[1:].encode()]), "".join(rng.choice("@+FI") for _ in range(n)).encode()


def counted(path, size, range_bytes):
    return C.chained(C.ranges_of([(0, str(path), size)], range_bytes), lambda some: [S.count_range(r) for r in some])


@pytest.mark.parametrize("way", WAYS)
def test_every_split_reads_every_record_once(tmp_path, monkeypatch, way):
    """Qualities that begin as headers do, names with signs, empty sequences, missing and additional line ends."""
    monkeypatch.setattr(C, "CHUNK", 64)
    monkeypatch.setattr(C, "PROOF", 64)
    rng = random.Random(way)
    for t in range(25):
        records = [record(rng, i) for i in range(rng.randint(0, 20))]
        raw = b"".join(b"\n".join(r) + b"\n" for r in records)
        if t % 3 == 0 and records and records[-1][3]:
            raw = raw[:-1]
        elif t % 3 == 1:
            raw += b"\n" * rng.randint(1, 5)
        data = WAYS[way](raw)
        (tmp_path / "x").write_bytes(data)
        for range_bytes in (1, 2, 3, 7, 20, 64, 1000) if t < 6 else (13, 50):
            got = []
            for r in counted(tmp_path / "x", len(data), range_bytes) if data else []:
                lines = [x for part in S.Records(r).lists() for x in part]
                assert len(lines) == 4 * r.n and r.base == len(got)
                got += [tuple(lines[i : i + 4]) for i in range(0, len(lines), 4)]
            assert got == records, (t, range_bytes)


def test_wrong_guess_is_mended(tmp_path):
    """A member that begins within a header, where the rest of the header looks like a record of its own."""
    raw = b"@a@b\nAC\n+\nFF\n@c\nGG\n+\nFF\n"
    data = gzip.compress(raw[:2]) + gzip.compress(raw[2:])
    (tmp_path / "x").write_bytes(data)
    cut = len(gzip.compress(raw[:2]))
    ranges = counted(tmp_path / "x", len(data), cut)
    heads = [x for r in ranges for part in S.Records(r).lists() for x in part[::4]]
    assert heads == [b"@a@b", b"@c"]


def test_damaged_containers_fail(tmp_path):
    data = gzip.compress(b"@a\nAC\n+\nFF\n" * 1000)
    (tmp_path / "x").write_bytes(data[:-20])
    with pytest.raises(EOFError):
        counted(tmp_path / "x", len(data) - 20, 1 << 20)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_have_no_shuffle(spark, tmp_path):
    for k, n in (("1", 12), ("2", 30)):
        raw = "".join(f"@r{i}/{k} d\n{'ACGT' * n}\n+\n{'@' * 4 * n}\n" for i in range(3000)).encode()
        (tmp_path / f"{k}.fastq").write_bytes(raw)
        (tmp_path / f"{k}.gz").write_bytes(pieces(raw, 30_000, gzip.compress))
    df = Q.read_fastq(spark, str(tmp_path / "1.fastq"), max_len=5, range_bytes=20_000)
    assert "Exchange" not in plan(df) and df.rdd.getNumPartitions() > 10
    assert [(r.rec_idx, r.name, r.descr, r.seq) for r in df.collect()] == [(i, f"r{i}/1", "d", "ACGTA") for i in range(3000)]
    packed = Q.read_fastq(spark, str(tmp_path / "1.gz"), range_bytes=1000)
    assert packed.rdd.getNumPartitions() > 3 and sorted(map(tuple, packed.drop("seq", "qual").collect())) == sorted(map(tuple, df.drop("seq", "qual").collect()))
    both = Q.read_lockstep(spark, {"R1": [str(tmp_path / "1.gz")], "R2": [str(tmp_path / "2.fastq")]}, {"R1": 3}, range_bytes=20_000)
    assert "Exchange" not in plan(both) and both.rdd.getNumPartitions() > 10
    rows = both.collect()
    assert [(r.rec_idx, r.name, r.R1.seq, len(r.R2.seq)) for r in rows] == [(i, f"r{i}", "ACG", 120) for i in range(3000)]
    shuffled = Q.lockstep({"R1": Q.read_fastq(spark, str(tmp_path / "1.gz"), 3), "R2": Q.read_fastq(spark, str(tmp_path / "2.fastq"))})
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, rows))


def test_lockstep_over_several_files_of_unequal_cuts(spark, tmp_path):
    for name, names in (("a1", range(5)), ("a2", range(5, 40)), ("b1", range(33)), ("b2", range(33, 40))):
        (tmp_path / f"{name}.fastq").write_text("".join(f"@r{i}\nA\n+\nF\n" for i in names))
    at = lambda *x: [str(tmp_path / f"{n}.fastq") for n in x]
    assert [r.name for r in Q.read_lockstep(spark, {"R1": at("a1", "a2"), "R2": at("b1", "b2")}, range_bytes=50).collect()] == [f"r{i}" for i in range(40)]
    with pytest.raises(ValueError, match="do not belong together"):
        Q.read_lockstep(spark, {"R1": at("a1", "a2"), "R2": at("b1")})
    with pytest.raises(Exception, match="do not belong together"):
        Q.read_lockstep(spark, {"R1": at("a1", "a2"), "R2": at("a2", "a1")}).collect()


def test_min_len_counts_the_bytes_of_a_record(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("@a\nAC\n+\nFF\n")
    assert Q.read_fastq(spark, str(tmp_path / "x.fastq"), min_len=11).count() == 1
    with pytest.raises(Exception, match="min_len"):
        Q.read_fastq(spark, str(tmp_path / "x.fastq"), min_len=12).collect()
    (tmp_path / "y.fastq").write_bytes(b"@a d\r\nAC\r\n+\r\nFF\r\n")
    assert tuple(Q.read_fastq(spark, str(tmp_path / "y.fastq")).select("seq", "qual", "descr").first()) == ("AC", "FF", "d")
