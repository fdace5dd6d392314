"""Operators against plain versions on random rows."""

import contextlib
import io
import itertools
import random

import pytest

from helixgrid.operators import barcodes as B
from helixgrid.operators import intervals as I
from helixgrid.operators import transcriptome as T
from helixgrid.operators.fragments import unique_fragments


def test_overlap_join(spark):
    rng = random.Random(1)
    rows = lambda n: [(i, rng.choice("ab"), s := rng.randrange(500), s + rng.randrange(60)) for i in range(n)]
    a, b = rows(150), rows(120)
    left = spark.createDataFrame(a, "id int, chrom string, start long, end long")
    right = spark.createDataFrame(b, "id int, chrom string, start long, end long")
    for contained in (False, True):
        got = sorted((r.id, r.f_id) for r in I.overlap_join(left, right, 16, contained).select("id", "f_id").collect())
        full = lambda x, y: y[2] <= x[2] and x[3] <= y[3] if contained else x[2] < y[3] and y[2] < x[3]  # noqa: B023, E731
        assert got == sorted((x[0], y[0]) for x, y in itertools.product(a, b) if x[1] == y[1] and x[3] > x[2] and y[3] > y[2] and full(x, y))


def _targets(counts):
    out = {}
    for (k, u), n in counts.items():
        best = max(((m, v) for (j, v), m in counts.items() if j == k and len(u) == len(v) and sum(a != b for a, b in zip(u, v)) == 1 and all(b in "ACGT" for a, b in zip(u, v) if a != b) and (m, v) > (n, u)), default=None)  # noqa: B905
        out[k, u] = best[1] if best else u
    return out


def test_umi_targets(spark):
    rng = random.Random(2)
    reads = [(rng.randrange(3), "".join(rng.choice("ACN" if i == 1 else "AC") for i in range(4)), i) for i in range(300)]
    counts = {}
    for k, u, _ in reads:
        counts[k, u] = counts.get((k, u), 0) + 1
    got = {(r.k, r.umi): r.target for r in T.umi_targets(spark.createDataFrame(reads, "k int, umi string, id int"), ["k"]).collect()}
    assert got == _targets(counts)


@pytest.mark.parametrize("distance", [1, 2])
def test_correct_barcodes(spark, distance):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    known = {text(5): rng.randrange(5) for _ in range(25)}
    reads = [(i, rng.choice([text(5), rng.choice(list(known))]), "".join(chr(33 + rng.randrange(45)) for _ in range(5))) for i in range(200)] + [(200, None, None), (201, "NACGT", "FFFFF")]
    counts = spark.createDataFrame(list(known.items()), "barcode string, n long")
    got = {r.id: r for r in B.correct_barcodes(spark.createDataFrame(reads, "id int, barcode string, qual string"), counts, ["id"], distance=distance, threshold=0.8, max_expected_errors=2.0).collect()}
    for i, q, quality in reads:
        if q is None:
            assert got[i].status == B.NO_MATCH and got[i].corrected is None
            continue
        p = [10 ** (-(ord(c) - 33) / 10) for c in quality]
        if sum(p) >= 2.0:
            assert got[i].status == B.TOO_MANY_ERRORS
            continue
        if q in known:
            assert (got[i].corrected, got[i].posterior) == (q, 1.0)
            continue
        near = {}
        for c, n in known.items():
            at = [k for k in range(5) if q[k] != c[k]]
            if len(at) <= distance:
                w = 1 + n
                for k in at:
                    w *= 10 ** (-(min(ord(quality[k]), 66) - 33) / 10)
                near[c] = w
        if not near:
            assert got[i].status == B.NO_MATCH
            continue
        top = max(near.values())
        assert got[i].posterior == pytest.approx(top / sum(near.values()))
        if top / sum(near.values()) >= 0.8:
            assert near[got[i].corrected] == pytest.approx(top) and got[i].status == B.OK
        else:
            assert got[i].status == B.LOW_CONFIDENCE and got[i].corrected is None


def test_unique_fragments_ignore_row_order(spark):
    rows = [("A", "chr1", 10, 60, "FR", 10 + i % 2, 60, None, f"r{i}") for i in range(6)] + [("A", "chr1", 10, None, "F", 9, 40, "+", "s"), (None, "chr1", 1, 2, "FR", 1, 2, None, "x"), ("B", "chr1", 3, 12, "FR", 0, 5, None, "e")]
    schema = "barcode string, chrom string, left_5p long, right_5p long, orientation string, frag_start long, frag_end long, strand string, name string"
    want = {("chr1", 14, 55, "A", 6, None), ("chr1", 9, 40, "A", 1, "+")}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = {tuple(r) for r in unique_fragments(spark.createDataFrame(rows, schema), 4, -5).collect()}
        assert got == want


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "chrom string, start long, end long, k int")
    assert I.overlap_join(empty, empty, 10).count() == 0 and I.merge_intervals(empty, ["k"]).count() == 0
    assert T.umi_targets(spark.createDataFrame([], "k int, umi string"), ["k"]).count() == 0
    stats = B.whitelist_stats(spark.createDataFrame([], "barcode string, n long, listed boolean")).first()
    assert (stats.total, stats.frac_exact) == (0, 0.0)


def test_overlap_join_of_all_lengths(spark):
    """Lengths from 1 to 10^8: every interval of the indexed side stays one row, and pairs meet once."""
    rng = random.Random(4)
    rows = lambda n: [(i, rng.choice("ab"), s := rng.randrange(10 ** rng.randint(1, 9)), s + int(10 ** rng.uniform(0, 8))) for i in range(n)]
    a, b = rows(120), rows(100) + [(100, "a", 0, 1 << 41), (101, "b", (1 << 40) - 5, (1 << 40) + 5)]
    left = spark.createDataFrame(a, "id int, chrom string, start long, end long")
    right = spark.createDataFrame(b, "id int, chrom string, start long, end long")
    for contained in (False, True):
        got = sorted((r.id, r.f_id) for r in I.overlap_join(left, right, 1 << 14, contained).select("id", "f_id").collect())
        meets = lambda x, y: y[2] <= x[2] and x[3] <= y[3] if contained else x[2] < y[3] and y[2] < x[3]  # noqa: B023, E731
        assert got == sorted((x[0], y[0]) for x, y in itertools.product(a, b) if x[1] == y[1] and meets(x, y))


def _merged(rows):
    out = []
    for k, s, e in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        if out and out[-1][0] == k and s <= out[-1][2]:
            out[-1][2], out[-1][3] = max(out[-1][2], e), out[-1][3] + 1
        else:
            out.append([k, s, e, 1])
    return sorted(map(str, out))


@pytest.mark.parametrize("bin_size", [7, 64, 1 << 16])
def test_merge_intervals_over_bins(spark, bin_size):
    """Unions that reach over many bins, touch at their borders, lie within others, or stand alone; a null key is one key."""
    for seed, longest in ((1, 5), (2, 60), (3, 900)):
        rng = random.Random(seed)
        rows = [(rng.choice(["a", "b", None]), s := rng.randrange(3000), s + rng.choice([1, 7, rng.randint(1, longest)])) for _ in range(250)]
        got = I.merge_intervals(spark.createDataFrame(rows, "k string, start long, end long"), ["k"], bin_size).select("k", "start", "end", "n").collect()
        assert sorted(str(list(r)) for r in got) == _merged(rows)


def test_merge_intervals_without_ends(spark):
    """Intervals without a start or an end stand alone unless their start is within reach, as in SQL with nulls behind all else."""
    rows = [("a", 3, 9), ("a", 5, None), ("a", 12, None), ("a", 12, None), ("a", 14, 30), ("a", None, 4), ("a", None, None), (None, 1, None), (None, 2, 40), (None, 39, None), (None, 45, 46)]
    want = [("a", 3, 9, 2), ("a", 12, None, 1), ("a", 12, None, 1), ("a", 14, 30, 1), ("a", None, 4, 1), ("a", None, None, 1), (None, 1, None, 1), (None, 2, 40, 2), (None, 45, 46, 1)]
    for bin_size in (4, 16, 1 << 16):
        got = I.merge_intervals(spark.createDataFrame(rows, "k string, start long, end long"), ["k"], bin_size).select("k", "start", "end", "n").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_islands_keep_no_rows_by_island(spark):
    """Groups are sorted once and read on; nothing holds a row for each of their unions in memory."""
    rows = spark.createDataFrame([("a", 1, 2, 1)], "k string, start long, end long, n long")
    with contextlib.redirect_stdout(io.StringIO()) as out:
        I._islands(rows, ["k"]).explain()
    assert "Aggregate" not in out.getvalue() and out.getvalue().count("Sort [") == 1


@pytest.mark.parametrize("rows_a_task,most_rows,tasks", [(50, 200, 40), (5, 40, 200), (5, 8, 250)])
def test_merge_intervals_spreads_by_rows(spark, monkeypatch, rows_a_task, most_rows, tasks):
    """Tasks become more with the rows, however few shuffle partitions a session has; unions stay as they are."""
    rng = random.Random(7)
    rows = [(rng.choice("abcdef"), s := rng.randrange(100_000), s + rng.randint(1, 300)) for _ in range(2000)]
    given = spark.createDataFrame(rows, "k string, start long, end long")
    dealt, kept = [], I.materialized
    monkeypatch.setattr(I, "ROWS_A_TASK", rows_a_task, raising=False)
    monkeypatch.setattr(I, "MOST_ROWS", most_rows, raising=False)
    monkeypatch.setattr(I, "materialized", lambda df: dealt.append(df.rdd.getNumPartitions()) or kept(df))
    got = I.merge_intervals(given, ["k"], 256).select("k", "start", "end", "n").collect()
    assert sorted(str(list(r)) for r in got) == _merged(rows) and dealt == [tasks]


@pytest.mark.parametrize("distance,keys", [(1, 16), (2, 120)])
def test_keys_of_near_entries(spark, distance, keys):
    """A text of 16 bases has 16 keys for one place, 120 for two; the entries met, their places and order are those of all pairs."""
    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(16))
    change = lambda t, k: "".join(rng.choice("ACGTN") if i in rng.sample(range(16), k) else c for i, c in enumerate(t))
    known = sorted({change(base, rng.randint(0, 3)) for _ in range(60)} | {"A", "AC", "ACG", ""})
    queries = sorted(({change(base, rng.randint(0, 2)) for _ in range(20)} | {"C", "AG", "TCG", ""}) - set(known))
    k = spark.createDataFrame([(c, i) for i, c in enumerate(known)], "cand string, n long")
    q = spark.createDataFrame([(x,) for x in queries], "q string")
    assert {len(r.m) for r in q.where("length(q) = 16").select(B._masks(q.q, B.F.length("q"), distance).alias("m")).collect()} == {keys}
    want = {}
    for x in queries:
        for n, c in enumerate(known):
            at = [i for i in range(len(x)) if x[i] != c[i]] if len(x) == len(c) else []
            if 0 < len(at) <= distance and all(c[i] in "ACGT" for i in at):
                spot = [(i + 1, "ACGT".index(c[i]) + 1) for i in at]
                want.setdefault(x, []).append((*spot[0], *(spot[1] if len(at) == 2 else (0, 0)), c, n))
    got = {r.q: [(e.cand, e.n) for e in r.near] for r in B.near_entries(q, k, distance).collect()}
    assert got == {x: [(c, n) for *_, c, n in sorted(v)] for x, v in want.items()}
