"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from helixgrid.llm.pieces import Pieces, check_model, sp_decode, sp_encode, sp_round_trip
from helixgrid.llm.vocab import default_path

PATH = default_path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "a", "aa", "in", "the", "The", "é", "▁", " ▁", "<s>", "</s>", "<unk>", "<0x0A>", "1", "２", "Ω", "中文", "字", "😀", "\x00", "ing", "er", "on", "ss", "tion", " the", "e", "t", "h", ".", "...", "ab", "ba"]
SCHEMA = "doc_id long, text string, id string, n_tokens int, ids string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def v():
    return Pieces(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    out += ["".join(rng.choice("ainthe ") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    out += [" " * k + "the" for k in range(40)] + [" " * k for k in range(40)]
    return [*out, "".join(rng.choice("abcdethein") for _ in range(4000)), " " * 3000, " " * 2000 + "the" + " " * 1001, "a" * 5000, "ab" * 4000, "中文字" * 2000]


def test_ids_and_texts_are_the_librarys(v, library, texts):
    want = library.encode(texts, add_eos=True)
    for text, ids, raw in zip(texts, want, v.encode(texts), strict=True):
        got = np.frombuffer(raw, "<u4")
        assert got.tolist() == ids, text[:50]
        assert v.decimals(got).decode() == " ".join(map(str, ids))
        assert v.decode(got).decode() == library.decode(ids)


def test_any_ids_decode_as_in_the_library(v, library):
    rng = random.Random(6)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 2, 1, 0, 259]) for _ in range(rng.randint(0, 12))]
        assert v.decode(np.array(ids, dtype=np.int64)).decode() == library.decode(ids), ids
    with pytest.raises(ValueError):
        v.decode(np.array([32000]))


def test_texts_of_a_million_characters(v, library):
    rng = random.Random(7)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)), " " * 1_000_000):
        assert np.frombuffer(v.encode([text])[0], "<u4").tolist() == library.encode(text, add_eos=True)


def test_bounds_of_cache_and_of_long_stretches_change_nothing(library, texts, monkeypatch):
    import helixgrid.llm.pieces as module

    monkeypatch.setattr(module, "LONG", 3)
    small = Pieces(PATH)
    small.known.most = 10
    want = library.encode(texts[:300], add_eos=True)
    assert [np.frombuffer(small.encode([t])[0], "<u4").tolist() for t in texts[:300]] == want


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        check_model(b"")


def test_queries_tables(spark, library, texts):
    rows = [(i, t, "x", -1, "y") for i, t in enumerate(texts[:500])]
    docs = spark.createDataFrame([*rows, (10_000, None, None, None, None), (None, "lost id", "x", 1, "y"), (5, texts[5], "x", -1, "y")], SCHEMA).repartition(3)
    of = {None: "lost id", 10_000: ""} | dict(enumerate(texts[:500]))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sp_round_trip(docs).collect()
    assert len(got) == 503
    for r in got:
        ids = library.encode(of[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))
    encoded = sp_encode(docs)
    assert {(r.doc_id, tuple(r.ids)) for r in encoded.collect()} == {(i, tuple(library.encode(t, add_eos=True))) for i, t in of.items()}
    assert {(r.doc_id, r.text) for r in sp_decode(encoded).collect()} == {(i, library.decode(library.encode(t))) for i, t in of.items()}
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in sp_decode(odd).collect()) == [(1, None), (2, "")]
    assert sp_round_trip(docs.limit(0)).count() == 0
