"""License scans, quality rules, toxicity, language and nearest neighbours against plain versions and held-out rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixgrid.llm import ann, language, licenses, long_words, quality, toxicity
from helixgrid.llm.vocab import default_path

# --- licenses


def _full_alignment(t, x):
    """Matched words of the best local alignment, over the whole matrix."""
    best, before = (0, 0), [(0, 0)] * (len(x) + 1)
    for a in t:
        here = [(0, 0)]
        for j, b in enumerate(x, 1):
            s, m = before[j - 1]
            c = max((s + 2, m + 1) if a == b else (s - 1, m), (before[j][0] - 1, before[j][1]), (here[-1][0] - 1, here[-1][1]))
            here.append(c if c[0] > 0 else (0, 0))
            best = max(best, here[-1])
        before = here
    return best[1]


def test_license_scan(spark):
    rng = random.Random(1)
    words = lambda t: [w.lower() for w in licenses.WORD.findall(t)]
    rows, filler = [], lambda n: " ".join(rng.choice(["alpha", "beta", "license", "the", "of", "software"]) for _ in range(n))
    for i in range(60):
        name = rng.choice(list(licenses.TEMPLATES))
        t = licenses.TEMPLATES[name].split()
        if i % 3 == 1 and len(t) > 20:
            t = [w for w in t if rng.random() > 0.05]
            t.insert(rng.randrange(len(t)), "extra")
        if i % 3 == 2:
            t = []
        rows.append((i, filler(30) + "\n" + " ".join(t) + "\n" + filler(30), name, bool(t)))
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t, *_ in rows] + [(None, "Released under the MIT License.", "x", 1.0), (99, None, "x", 1.0), (98, "", "x", 1.0)], "doc_id long, text string, template string, coverage double")
    got = {}
    for r in licenses.scan_licenses(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {i for i in got if i is not None} == {i for i, *_, on in rows if on} and len(got[None]) == 1
    for i, text, name, on in rows:
        if on:
            (r,) = got[i]
            t = words(licenses.TEMPLATES[name])
            assert r.template == name and r.template_words == len(t)
            assert r.matched_words == pytest.approx(_full_alignment(t, words(text)), abs=2) and r.coverage >= 0.75
            assert words(text[r.start_char : r.end_char])[0] == t[0] or r.coverage < 1
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_bodies_and_edits(spark):
    """Whole texts with edits: recall, both ends of the span, and matched words against full alignment; short notices of
    other licenses and versions, and texts of common words, are left alone."""
    rng, templates = random.Random(9), licenses.default_templates()
    words = lambda t: [w.lower() for w in licenses.WORD.findall(t)]
    rows, want = [], {}
    for i, (name, share) in enumerate((n, s) for n in ("mit", "isc", "bsd-2-clause", "bsd-3-clause", "zlib", "unlicense", "apache-2.0", "gpl-2", "mpl-2.0", "apache-2.0-header") for s in (0.0, 0.05, 0.1)):
        t = [w if rng.random() >= share or k in (0, 1, 2) or k >= len(words(templates[name])) - 3 else "edited" for k, w in enumerate(words(templates[name]))]
        want[i] = name
        rows.append((i, "some words before " + " ".join(t) + " and words behind"))
    rows += [(900, "Licensed under the Apache License, Version 1.1."), (901, "This work is licensed under the GNU General Public License, version 1."), (902, "of the software and the license " * 3000), (903, "x " * 500_000 + "Released under the MIT License.")]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    got = {}
    for r in licenses.scan_licenses(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {*want, 903} and len(got[0]) == 2 * len([1])
    text = dict(rows)
    for i, name in want.items():
        r = max(got[i], key=lambda r: r.matched_words)
        assert r.template == name, (name, r)
        span = words(text[i][r.start_char : r.end_char])
        assert span[:3] == words(templates[name])[:3] and span[-3:] == words(templates[name])[-3:]
        if r.template_words < 400:
            assert abs(r.matched_words - _full_alignment(words(templates[name]), words(text[i]))) <= 1
    assert text[903][got[903][0].start_char : got[903][0].end_char] == "Released under the MIT License"


def test_license_twice_in_a_text():
    s = "Released under the MIT License. " * 2
    found = next(iter(licenses.Scanner(licenses.TEMPLATES, 0.75).scan([s])))
    assert [(m[0], m[1], m[2]) for m in found] == [("mit-notice", 0, 30), ("mit-notice", 32, 62)]


# --- quality


def _counts(x):
    w = [a for a in re.split(r"[\x20\x09-\x0D]+", x or "") if a]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [a for a in (x or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", a)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x or ""), len(lines) - len(set(lines)), len(cover)


def test_text_counts(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "dd\t", "#", "é ", "\xa0", "\n", "  ", "!"]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += [None, "", " \n\t", "x", "a b c d e a b c d e f", "a " * 50, "a b c d e", "a\r\nb\na\r\nb"]
    df = spark.createDataFrame([(i, t, "z", 0) for i, t in enumerate(texts)], "doc_id long, text string, words string, n_words int")
    for r in quality.text_counts(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _counts(texts[r.id]), texts[r.id]


def test_decision_list(spark):
    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    rows = [(i, good() if i % 4 else " ".join(w + rng.choice("#$%") for w in good().split()), int(i % 4 > 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (None, good())], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 300] + [(None, 0), (1, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    assert all(out[i].kept == bool(q) for i, _, q in rows) and not out[1000].kept and out[1000].base_failed and out[None].kept
    none = quality.quality_rules(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none) and quality.quality_rules(docs.limit(0), labels).count() == 0


def test_quality_plan_is_native(spark, sf_dir):
    df = quality.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    text = df._jdf.queryExecution().toString() + quality.text_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text)


# --- toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows = []
    for i in range(1200):
        t, bad = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))], int(rng.random() < 0.2)
        for _ in range(bad * rng.randint(1, 4)):
            t.insert(rng.randrange(len(t)), rng.choice(["grobian", "schuft"]))
        rows.append((i, " ".join(t), bad))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (None, "some text", "x"), (5001, "", "x")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == 1203 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    held = [(out[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held) and np.mean([r.predicted == y for r, y in held]) > 0.97
    assert not out[5000].held_out or zlib.crc32(b"5000") % 4 == 2
    assert out[5000].score == out[5001].score
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs.limit(5), labels.limit(0)).collect()} == {0.0}


# --- language


def test_forward_sums_all_segmentations():
    path = default_path("piece_bpe_32k.model")
    index, _ = language.pieces(path)
    rng = np.random.default_rng(5)
    prob = rng.random((len(index) + 1, 3))
    prob /= prob.sum(axis=0)
    scorer = language.Scorer(path, prob)
    table = np.vstack([prob, np.ones((1, 3)), np.zeros((1, 3))])

    def in_stretches(found):
        return long_words.log_sums(scorer.lattice.stretches(found), lambda piece, _: table[piece], 3)

    def plain(w):
        s = "▁" + w

        def go(i):
            if i == len(w):
                return np.ones(3)
            total = np.zeros(3)
            for j in range(i + 1, len(w) + 1):
                p = index.get(s[: j + 1] if i == 0 else s[i + 1 : j + 1], 0 if j == i + 1 else -1)
                if p >= 0:
                    total += prob[p] * go(j)
            return total

        return np.log(go(0))

    for w in ["the", "onelésse", "x", "ththtion", "ñŋß", "中文字"]:
        assert np.allclose(scorer.score([w])[0], plain(w)) and np.allclose(in_stretches([w])[0], plain(w))
    one, two = np.zeros(prob.shape), np.zeros(prob.shape)
    for w in ("theoldone", "überlong"):
        language._expect(scorer.lattice.build(["▁" + w]), prob, np.array([1]), np.array([2.0]), one)
        for piece, _, worth in long_words.expected(scorer.lattice.stretches([w]), lambda k, _: table[k, 1][:, None], np.array([2.0])):
            np.add.at(two[:, 1], piece, worth)
    assert np.allclose(one, two)


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(100_000, None, "en"), (100_001, "", None), (100_002, "123 !?", "en"), (None, "und der die das", "de"), (100_003, "中" * 500, None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.language_id(docs.unionByName(extra)).collect()}
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (100_000, 100_001, 100_002)) and out[None].lang_pred == "de"
    rows = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert rows and all(out[r.doc_id].held_out for r in rows) and np.mean([out[r.doc_id].lang_pred == r.lang for r in rows]) > 0.95
    assert language.language_id(docs.limit(0)).count() == 0
    blank = language.language_id(docs.limit(3), taught=docs.limit(0)).collect()
    assert {(r.lang_pred, r.score) for r in blank} == {("und", 0.0)}


# --- nearest neighbours


def _exact(rows, every, k):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            s = u @ u[n]
            out[i] = [(ids[j], s[j]) for j in np.lexsort((ids, -s.round(12))) if ids[j] != i][:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 12))
    rows = [(int(i), (centres[i % 20] + 0.4 * rng.normal(size=12)).tolist()) for i in range(1500)]
    hot = rng.normal(size=12).tolist()
    rows += [(int(i), hot) for i in range(2000, 2500)]
    odd = [(3000, None), (3050, [0.0] * 12), (3100, [float("nan")] + [1.0] * 11), (3150, [None] + [1.0] * 11), (3200, []), (None, [1.0] * 12), (3250, [float("inf")] * 12)]
    df = spark.createDataFrame([(*r, "x", 0.0) for r in rows + odd], "vec_id long, embedding array<double>, dim string, score double")
    got = {}
    for r in ann.nearest(df, shard=512).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = _exact(rows, 50, 5)
    assert set(got) == set(want) and all(sorted(x[0] for x in v) == [1, 2, 3, 4, 5] for v in got.values())
    hits = sum(s >= want[q][-1][1] - 1e-9 for q, v in got.items() for _, _, s in v)
    assert hits / (5 * len(want)) >= 0.97
    for q in (2000, 2050):  # copies: ties go to the smallest ids
        assert [x[1] for x in sorted(got[q])] == [i for i in range(2000, 2006) if i != q][:5]


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (50, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_every_vector_is_indexed(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    nodes = ann.distinct_vectors(ann.usable(df, "vec_id", "embedding"), 6)
    index = ann.build_index(nodes, 3)
    assert sorted(i for r in index.select("nodes").collect() for i in np.frombuffer(bytes(r.nodes), "<i8").tolist()) == list(range(300))
    assert nodes.agg(F.max(F.size("ids"))).first()[0] == 1


def test_nearest_of_all_magnitudes(spark):
    """Directions count, however small or large the vectors are; repeated rows count once; settings stay as they were."""
    rng = np.random.default_rng(8)
    base = [rng.normal(size=6) for _ in range(60)]
    rows = [(i, (base[i] * scale).tolist()) for i, scale in zip(range(60), [1e-170, 1e200, 1.0, 3e-320] * 15, strict=True)]
    rows += [(100, (base[3] * 1e200).tolist()), (150, (base[7] * 1e-170).tolist())] + rows[:5]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert spark.conf.get(key) == before and set(got) == {0, 50, 100, 150} and all(sorted(x) == [1, 2, 3, 4, 5] for x in got.values())
    assert got[150][1][0] == 7 and got[150][1][1] == pytest.approx(1)
    scaled = [(i, np.array(v) / np.abs(v).max()) for i, v in dict(rows).items()]
    want = _exact([(i, v.tolist()) for i, v in scaled], 50, 5)
    assert {q: [x[0] for _, x in sorted(v.items())] for q, v in got.items() if q in (50, 100)} == {q: [i for i, _ in want[q]] for q in (50, 100)}
