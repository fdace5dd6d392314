"""Near duplicates and components against plain versions."""

import random

import numpy as np
import pytest

from helixgrid.llm.components import connected_components
from helixgrid.llm.near_dup import MinMax, Shingler, near_duplicates


def _sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def _plain(rows):
    sets, parent = _sets([t for _, t in rows]), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    out, common = [], [word() for _ in range(40)]
    for g in range(25):
        base = [word() for _ in range(rng.choice([3, 8, 30, 120]))] + (common if g % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 6])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = word()
            out.append(rng.choice([" ", "\n", "\t "]).join(t))
    out += ["", " \n", "Ä Same", "ä Same", "SAME same", "same SAME", "one word", "x", "x"]
    rng.shuffle(out)
    return [(int(d), t) for d, t in zip(rng.sample(range(10_000), len(out)), out, strict=True)]


def test_near_duplicates(spark, rows):
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, node int, n string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == _plain(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in near_duplicates(df).collect())


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(3, "a b c"), (3, "a b c"), (1, "A B  C"), (None, "a b c"), (7, None), (None, None), (8, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 1, 1, False), (3, 1, 1, False), (1, 1, 1, True), (None, 1, 1, False), (7, 0, 7, True), (None, 0, None, True), (8, 0, 8, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_one_large_group(spark):
    """A third of the rows in one group of near copies, another third copies of one text."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    near = [(i, " ".join("zz" if k == rng.randrange(200) else w for k, w in enumerate(base))) for i in range(200)]
    df = spark.createDataFrame(near + [(1000 + i, "copy of one and the same text") for i in range(200)] + [(2000 + i, f"alone {i} in its own words here {i}") for i in range(200)], "doc_id long, text string")
    got = near_duplicates(df).groupBy("component_id").count().collect()
    assert sorted(r["count"] for r in got)[-2:] == [200, 200] and len(got) == 202


def test_min_max_estimates():
    rng = np.random.default_rng(4)
    m, a = MinMax(400, 5), rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = np.concatenate([a[:225], rng.integers(0, 1 << 63, 75, dtype=np.uint64)])
    (l1, h1), (l2, h2) = m.extremes(a), m.extremes(b)
    assert np.mean([(l1 == l2).mean(), (h1 == h2).mean()]) == pytest.approx(225 / 375, abs=0.05)
    x = (a >> np.uint64(32)).astype(np.uint32)
    assert l1[7] == (m.a[7] * x + m.b[7]).min() and h1[7] == (m.a[7] * x + m.b[7]).max()


def test_shingles_follow_white_space():
    s = Shingler(5)
    a, b, c, d = s.sets([b"A b\x0bc d e f", b"a B c\td  e\x0cf", "a b c d e f".encode(), None])
    assert a.tolist() == b.tolist() and len(a) == 2 and len(c) == 1 and len(d) == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, x) for x in range(5001, 5100)] + [(9, 9)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
