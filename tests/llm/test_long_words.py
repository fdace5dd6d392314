"""Long words: sums and expected counts in stretches against plain logarithms; languages in blocks; very long texts."""

import time

import numpy as np
import pytest

from helixgrid.llm import language, long_words
from helixgrid.llm.vocab import default_path


@pytest.fixture(scope="module")
def model():
    path = default_path("piece_bpe_32k.model")
    index, longest = language.pieces(path)
    prob = np.random.default_rng(3).random((len(index) + 1, 2)) ** 8 + 1e-12
    prob /= prob.sum(axis=0)
    return index, longest, prob, language.Lattice(path), np.vstack([prob, np.ones((1, 2)), np.zeros((1, 2))])


def plain(word, index, longest, prob):
    """Logarithm of a word's sum and the expected counts of its pieces, by logarithms from place to place."""
    n, logs = len(word), np.log(prob)
    marked = "▁" + word
    edges = []
    for i in range(n):
        for j in range(i + 1, min(n, i + longest) + 1):
            p = index.get(marked[: j + 1] if i == 0 else marked[i + 1 : j + 1], 0 if j == i + 1 else -1)
            if p >= 0:
                edges.append((i, j, p))
    a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    a[0] = b[n] = 0
    for i, j, p in edges:
        a[j] = np.logaddexp(a[j], a[i] + logs[p])
    for i, j, p in reversed(edges):
        b[i] = np.logaddexp(b[i], logs[p] + b[j])
    counts = np.zeros(len(prob))
    for i, j, p in edges:
        counts[p] += np.exp(a[i] + logs[p] + b[j] - a[n])
    return a[n], counts


@pytest.mark.parametrize("cells", [long_words.CELLS, 1500])
def test_stretches_equal_logarithms_from_place_to_place(model, monkeypatch, cells):
    monkeypatch.setattr(long_words, "CELLS", cells)
    index, longest, prob, lattice, table = model
    rng = np.random.default_rng(8)
    letters = list("etaoinshr") + list("中文字ñ")
    words = ["".join(rng.choice(letters, n)) for n in (1, 15, 16, 17, 31, 32, 33, 48, 200, 333)] + ["the" * 40, "a" * 64, "international" * 9]
    rng.shuffle(words)
    got = long_words.log_sums(lattice.stretches(words), lambda piece, _: table[piece], 2)
    lang, times = rng.integers(0, 2, len(words)), rng.integers(1, 5, len(words)).astype(float)
    total = np.zeros((len(words), len(prob)))
    for piece, word, worth in long_words.expected(lattice.stretches(words), lambda k, w: table[k, lang[w]][:, None], times):
        np.add.at(total, (word, piece), worth)
    for i, w in enumerate(words):
        for c in range(2):
            assert np.isclose(got[i, c], plain(w, index, longest, prob[:, c])[0], rtol=1e-9)
        assert np.allclose(total[i], times[i] * plain(w, index, longest, prob[:, lang[i]])[1], atol=1e-9)


def test_one_word_of_a_million_letters_takes_the_time_of_many(model):
    _, _, _, lattice, table = model
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000))

    def took(words):
        start = time.perf_counter()
        out = long_words.log_sums(lattice.stretches(words), lambda piece, _: table[piece], 2)
        return time.perf_counter() - start, out

    many, _ = took([text[i : i + 50] for i in range(0, len(text), 50)])
    one, out = took([text])
    assert np.isfinite(out).all() and one < 5 * many + 5


def test_languages_in_blocks_give_what_one_block_gives(spark, monkeypatch):
    said = {"de": "und der die das nicht ist", "en": "the and of that is not", "fr": "le la les est pas dans", "es": "el los las que no por"}
    rows = [(i, said[k], k, "x") for i, k in enumerate(sorted(said) * 6)] + [(90, None, None, None), (91, "12 !", "en", None), (92, "", None, None), (93, "q" * 200_000, None, None), (93, "nicht der", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    whole = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.language_id(docs).collect()}
    monkeypatch.setattr(language, "LANGUAGES_TOGETHER", 3)
    parts = language.language_id(docs).collect()
    assert {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in parts} == whole and len(parts) == len(rows)
    assert {r.lang_pred for r in parts if r.doc_id in (90, 91, 92)} == {"und"}


def test_ties_go_to_the_first_language_by_name(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "same words here", k) for i in range(20) for k in ("xx", "aa", "mm")], "doc_id long, text string, lang string")
    for most in (500, 1):
        monkeypatch.setattr(language, "LANGUAGES_TOGETHER", most)
        out = language.language_id(docs).collect()
        assert {r.lang_pred for r in out} == {"aa"} and len(out) == 60 and all(abs(r.score - 1 / 3) < 1e-9 for r in out)
