"""Sets meet by their first shingles: linked ones always, those with only frequent shingles in common not."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixgrid.llm import near_dup


@pytest.mark.parametrize("percent", [75, 50, 90, 100])
def test_prefix_lengths_lose_no_linked_pair(percent):
    """Every size of two sets with the fewest shared shingles that link them, the shared ones last in the order."""
    for x in range(1, 60):
        for y in range(1, x + 1):
            shared = next((o for o in range(y + 1) if 100 * o >= percent * (x + y - o)), None)
            if shared is not None:
                long, short = near_dup.prefix_lengths(x, percent)[1], near_dup.prefix_lengths(y, percent)[0]
                assert long > x - shared and short > y - shared


def _sets(spark, sets):
    rows = [(i, np.unique(np.array(sorted(s), np.uint64)).tobytes()) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "node long, set binary").repartition(3)


def test_linked_sets_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PLACES", 64)  # many shingles to a place: an order of any kind is right
    rng = random.Random(4)
    sets = []
    for _ in range(12):
        base = [rng.getrandbits(63) for _ in range(rng.choice((1, 2, 7, 40)))]
        for _ in range(6):
            kept = [x for x in base if rng.random() > 0.1] or base[:1]
            sets.append({*kept, *(rng.getrandbits(63) for _ in range(rng.randrange(max(1, len(base) // 5))))})
    met = {}
    for r in near_dup.sharing(_sets(spark, sets), 75).collect():
        met.setdefault(r.key, set()).add(r.node)
    pairs = {p for nodes in met.values() for p in itertools.combinations(sorted(nodes), 2)}
    linked = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert linked and linked <= pairs


def test_rows_with_a_passage_in_common_do_not_meet(spark):
    """Similarity 0.6 by one long passage: no row is compared with another."""
    sets = [{*range(75), *(1000 + 25 * i + k for k in range(25))} for i in range(400)]
    assert near_dup.sharing(_sets(spark, sets), 75).isEmpty()


def test_groups_of_equal_members_are_one(spark):
    out = near_dup.sharing(_sets(spark, [{*range(100), 200 + i} for i in range(5)]), 75)
    assert out.groupBy("key").agg(F.collect_set("node").alias("nodes")).count() == 1 and out.count() == 5


def test_no_sets(spark):
    assert near_dup.sharing(_sets(spark, [{1}]).limit(0), 75).isEmpty()
