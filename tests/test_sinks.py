"""Text with a header in front, part files, and sparse matrices in blocks and as files."""

import gzip
import random

import pytest

from helixgrid.operators import transcriptome as T
from helixgrid.sources import alignments as A
from helixgrid.sources.parts import BLOCK, PartsWriter, write_lines


def whole(folder, opener=gzip.decompress):
    return opener(b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))).decode()


def test_fragment_files_are_one_file(spark, tmp_path):
    rng = random.Random(1)
    rows = [("chr1", s := rng.randrange(10_000), s + 50, f"B{rng.randrange(300)}", 1, None) for _ in range(3000)]
    f = spark.createDataFrame(rows, "chrom string, start long, end long, barcode string, count long, strand string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        A.write_fragments(f, str(tmp_path / "f"), {"id": "x", "reference": "y"})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "f").glob("part-*"))) > 1 and not (tmp_path / "f_header").exists()
    lines = whole(tmp_path / "f").splitlines()
    assert lines[:2] == ["# id=x", "# reference=y"]
    want = [f"{c}\t{s}\t{e}\t{b}\t{n}\t." for c, s, e, b, n, _ in sorted(rows, key=lambda r: (r[3], r[0], r[1], r[2], r[4]))]
    assert lines[2:] == want
    assert sorted(map(tuple, A.read_fragments(spark, str(tmp_path / "f")).collect())) == sorted(rows)
    A.write_fragments(f.limit(0), str(tmp_path / "e"), {"id": "x"}, "none")
    assert whole(tmp_path / "e", bytes) == "# id=x\n"


def test_lines_longer_than_blocks(spark, tmp_path):
    text = ["x" * (3 * BLOCK + 5), "é" * 100, ""]
    write_lines(spark.createDataFrame([(t,) for t in text], "value string").coalesce(1), str(tmp_path / "t"))
    assert whole(tmp_path / "t").split("\n")[:-1] == text
    with pytest.raises(ValueError):
        write_lines(spark.range(1), str(tmp_path / "u"), compression="lzo")


def test_only_attempts_that_count_are_kept(tmp_path):
    """A task that ran twice, a task of a failed job, and a second job in one folder."""

    class Writer(PartsWriter):
        def put(self, rows, f, part):
            f.write("".join(rows).encode())

    w = Writer(str(tmp_path / "a"), ".txt", False)
    w._attempt(["lost"], 0)
    kept = [w._attempt(["b"], 1), w._attempt(["a"], 0)]
    w.commit(kept)
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["part-00000.txt", "part-00001.txt"] and whole(tmp_path / "a", bytes) == "ab"
    failed = Writer(str(tmp_path / "a"), ".txt", False)
    failed._attempt(["x"], 0)
    failed.abort([])
    more = Writer(str(tmp_path / "a"), ".txt", False)
    more.commit([more._attempt(["c"], 0)])
    assert whole(tmp_path / "a", bytes) == "abc"
    anew = Writer(str(tmp_path / "a"), ".txt", True)
    anew.commit([anew._attempt(["d"], 0)])
    assert whole(tmp_path / "a", bytes) == "d" and len(list((tmp_path / "a").iterdir())) == 1


def counts(spark, rng, cells=60):
    rows = [(f"c{rng.randrange(cells):03}", rng.randrange(40), rng.randrange(1, 9)) for _ in range(900)]
    return {(c, g): v for c, g, v in rows}


@pytest.mark.parametrize("entries", [1, 50, 1 << 20])
def test_blocks_are_the_matrix(spark, entries):
    cells = counts(spark, random.Random(entries))
    df = spark.createDataFrame([(c, g, v) for (c, g), v in cells.items()], "barcode string, gene_idx long, value long").repartition(5)
    names = sorted({c for c, _ in cells})
    at = end = 0
    for b in T.csr_blocks(df, entries=entries).orderBy("first_row").collect():
        assert b.first_row == at and b.cells == names[at : at + len(b.cells)] and b.indptr[0] == end
        for i, c in enumerate(b.cells):
            x, y = b.indptr[i] - b.indptr[0], b.indptr[i + 1] - b.indptr[0]
            assert list(zip(b.indices[x:y], b.data[x:y], strict=True)) == sorted((g, v) for (d, g), v in cells.items() if d == c)
        assert len(b.indices) < entries + 40
        at, end = at + len(b.cells), b.indptr[-1]
    assert at == len(names) and end == len(cells)
    assert T.csr_blocks(df.limit(0)).count() == 0


def test_matrix_files(spark, tmp_path):
    cells = counts(spark, random.Random(7))
    df = spark.createDataFrame([(c, g, v) for (c, g), v in cells.items()], "barcode string, gene_idx long, value long")
    genes = spark.createDataFrame([(f"g{i}", f"n{i}" if i % 2 else None, i) for i in range(41)], "gene_id string, gene_name string, gene_idx long")
    A.write_matrix(df, genes, str(tmp_path / "m"))
    lines = whole(tmp_path / "m/matrix.mtx").splitlines()
    names = sorted({c for c, _ in cells})
    assert lines[:2] == ["%%MatrixMarket matrix coordinate integer general", f"41 {len(names)} {len(cells)}"]
    assert lines[2:] == [f"{g + 1} {names.index(c) + 1} {v}" for (c, g), v in sorted(cells.items())]
    assert whole(tmp_path / "m/barcodes.tsv").splitlines() == names
    assert whole(tmp_path / "m/features.tsv").splitlines() == [f"g{i}\tn{i}" if i % 2 else f"g{i}\tg{i}" for i in range(41)]
