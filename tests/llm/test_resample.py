"""Importance resampling against a plain version; the quickselect against sorting."""

import hashlib
import math
import random
import re
import zlib

import pytest

from helixgrid.llm.resample import kth_key, resample

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, target, longest=1, buckets=10_000, least=20, percent=10):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    def features(text):
        w = words(text)
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for f in features(text):
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    eligible = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for n, r in enumerate(eligible[: len(eligible) * percent // 100]):
        r[4] = n + 1
    return sorted(str(tuple(r[:5])) for r in out)


@pytest.fixture(scope="module")
def target(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return df, [r.text for r in df.select("text").collect()]


def found(*args, **more):
    return sorted(str(tuple(r)) for r in resample(*args, **more).collect())


def test_whole_table(spark, sf_dir, target):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(docs, target[0]) == plain(rows, target[1])
    assert found(docs, target[0], longest=2, buckets=500, percent=37) == plain(rows, target[1], 2, 500, percent=37)


def test_ties_nulls_repeats_and_long_texts(spark, target):
    rows = [(i % 40, "Wörd x9 " * (10 + i % 3)) for i in range(300)] + [(None, "a b " * 20)] * 5 + [(7, None), (None, None), (8, ""), (9, "A" * 500_000 + " z" * 300_000)]
    df = spark.createDataFrame([(i, t, "x", 5, None) for i, t in rows], "doc_id long, text string, id string, n_features int, rank long").repartition(4)
    assert found(df, target[0]) == plain(rows, target[1])
    assert found(df, target[0].limit(0)) == plain(rows, [])
    assert found(df.limit(0), target[0]) == []


def test_kth_key_is_that_of_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(-3, 3), rng.random() < 0.1, rng.randrange(5), rng.randrange(3), i) for i in range(500)]
    df = spark.createDataFrame(rows, "_score long, _late boolean, _id long, n_features long, _row long")
    for k in (1, 2, 250, 499, 500):
        assert kth_key(df, k, seed=k) == sorted(rows)[k - 1]
