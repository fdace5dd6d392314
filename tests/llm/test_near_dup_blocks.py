"""Links within crowded buckets against plain comparison, and the size of the groups that are compared."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixgrid.llm import near_dup


def _plain(rows, percent=75):
    """Components of texts by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def _loose(n, seed, words=60):
    """A group of near copies, most pairs of which lie just under 0.75, while some are linked."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    return [(i, " ".join("x%d" % rng.randrange(40) if k in at else w for k, w in enumerate(base))) for i, at in enumerate({rng.randrange(words)} for _ in range(n)) for at in [at | {rng.randrange(words)}]]


@pytest.mark.parametrize("sizes", [(1024, 4096, 1 << 18, 1 << 20), (64, 32, 4000, 2000)])
def test_loose_group_loses_no_link(spark, monkeypatch, sizes):
    for name, value in zip(("SKETCH_ROWS", "SKETCH_ASKS", "SET_ROWS", "SET_ASKS"), sizes, strict=True):
        monkeypatch.setattr(near_dup, name, value)
    rows = _loose(2000 if sizes[0] == 1024 else 300, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    want = _plain(rows)
    assert got == want and len(set(want.values())) < len(rows)


def test_every_asking_row_meets_every_row_in_bounded_groups(spark):
    rows = spark.range(700).select(F.lit(5).cast("long").alias("key"), F.col("id").alias("node"), F.least("id", F.lit(300)).alias("comp"), F.lit(3).cast("long").alias("n"), (F.col("id") % 2 == 0).alias("asks"))
    out = near_dup.blocked(rows, F.col("n"), 300, 150).collect()
    groups = {}
    for r in out:
        groups.setdefault((r.ask, r.block), ([], []))[r.asks].append(r.node)
    met = {(a, b) for here, asks in groups.values() for a in asks for b in here}
    assert met == {(a, b) for a in range(0, 700, 2) for b in range(700)}
    assert max(len(x) for g in groups.values() for x in g) < 3 * 100


def test_links_of_a_group_are_a_forest():
    rng = np.random.default_rng(2)
    sets = [np.unique(np.concatenate([np.arange(100), rng.integers(1000, 2000, 5)])).astype(np.uint64).tobytes() for _ in range(60)]
    table = pa.table({"asks": [True] * 60 + [False] * 60, "node": list(range(60)) * 2, "comp": list(range(60)) * 2, "set": pa.array(sets * 2, pa.binary())})
    links = near_dup._linking(75)(table)
    assert links.num_rows == 59


def test_repeated_ids_with_two_texts_and_clashing_columns(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, "word " * 400_000), (5, "word " * 400_000 + "end")]
    df = spark.createDataFrame([(i, t, 7, "k", b"s", 1) for i, t in rows], "doc_id long, text string, node int, key string, sketch binary, n int")
    got = {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
