"""Token counts, byte BPE, packing and token files against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from helixgrid.llm import byte_bpe, packing, token_files, vocab
from helixgrid.llm.token_counts import prove_whole_tokens, token_counts

PARTS = [" ", "  ", "\n", "\t", "a", "The", "é", "É", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "1", "23", "２", "Ω", "€", "中文", "́", "Å", "\x1c", "\x00", "İ", " ", "\xa0", "Σ", ".", "...", "don't", " \n", "😀", "‍", "Hello", "worLD", "ﬁ", "\x85", "²", "œ", "¡", "ß"]
SCHEMA = "doc_id long, text string, id string, n_tokens int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    return [*out, "", " ", "a" * 3000, "".join(rng.choice("abcdethe") for _ in range(5000)), " " * 500 + "x", "中文" * 200]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Clashing extra columns, a null text, a null id and a repeated row."""
    rows = [(i, t, "x", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (10_000, None, None, None), (None, "lost id", "x", 1), (5, texts[5], "x", -1)], SCHEMA).repartition(3)


def _library(name, texts):
    return [e.ids for e in vocab.load(vocab.default_path(name)).encode_batch(texts, add_special_tokens=False)]


def test_token_counts(docs, texts):
    want = [len(x) for x in _library("word_bpe_49k.json", texts)]
    rows = token_counts(docs, limit=100).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        if r.doc_id is not None and r.doc_id < 10_000:
            t = texts[r.doc_id]
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), want[r.doc_id], want[r.doc_id] > 100)
        elif r.doc_id == 10_000:
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (0, 0, False)
    assert token_counts(docs.limit(0)).count() == 0


def test_whole_tokens_are_whole():
    tok = vocab.load(vocab.default_path("word_bpe_49k.json"))
    some = sorted(prove_whole_tokens(vocab.default_path("word_bpe_49k.json")))
    assert len(some) > 10_000
    for e in tok.encode_batch(random.Random(3).sample(some, 500), add_special_tokens=False):
        assert len(e.ids) == 1


@pytest.mark.parametrize("name,spaces", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder(texts, name, spaces):
    got = [np.frombuffer(x, "<u4").tolist() for x in vocab.Encoder(vocab.default_path(name), spaces).encode(texts)]
    assert got == _library(name, texts)


def test_cache_bound_changes_nothing(texts):
    e = vocab.Encoder(vocab.default_path("byte_bpe_50k.json"), True)
    e.known.most = 10
    want = _library("byte_bpe_50k.json", texts[:200])
    assert [np.frombuffer(e.encode([t])[0], "<u4").tolist() for t in texts[:200]] == want


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=byte_bpe._pattern(), mergeable_ranks=byte_bpe.read_ranks(vocab.default_path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_bpe_round_trip(docs, texts, reference):
    for r in byte_bpe.bpe_round_trip(docs).collect():
        text = {None: "lost id", 10_000: ""}.get(r.doc_id) if r.doc_id in (None, 10_000) else texts[r.doc_id]
        ids = np.array(reference.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_encode_and_decode(docs, texts, reference):
    back = byte_bpe.bpe_decode(byte_bpe.bpe_encode(docs.where("doc_id < 50"))).collect()
    assert {(r.doc_id, bytes(r.bytes).decode()) for r in back} == {(i, t) for i, t in enumerate(texts[:50])}


def test_segment_tree_of_long_words(reference):
    v = byte_bpe.vocabulary(vocab.default_path("byte_bpe_50k.tiktoken"), byte_bpe._pattern())
    rng = random.Random(4)
    for n in (129, 500, 2000):
        w = "".join(rng.choice("etaoins") for _ in range(n)).encode()
        assert v.merge_long(w) == reference.encode_ordinary(w.decode())
        if n == 129:
            assert np.frombuffer(v.merge_together([w], 256)[0], "<u4").tolist() == v.merge_long(w)


@pytest.mark.parametrize("by", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(100, 100, 1e4), (100, 3, 1e4), (100, 100, 1.2e4)])
def test_vector_best_fit_keeps_constraints(by, caps):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 100, 400)
    bins, offsets = packing.vector_best_fit(lengths, caps, by=by)
    for b in np.unique(bins):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offsets[at])]
        assert lengths[at].sum() <= caps[0] and len(at) <= caps[1] and (lengths[at].astype(float) ** 2).sum() <= caps[2] + 1e-6
        assert offsets[at].tolist() == (np.cumsum(lengths[at]) - lengths[at]).tolist()
    if caps == (100, 100, 1e4):
        assert len(np.unique(bins)) <= np.ceil(lengths.sum() / 100) * 1.05


def test_preferred_capacities_decide_and_cost_nothing():
    rng = np.random.default_rng(6)
    lengths = np.minimum(rng.lognormal(5, 1.2, 3000).astype(int) + 1, 4095)
    fewest, caps = -(-int(lengths.sum()) // 4096), (4096, 4096, 4096.0**2)
    plain, _ = packing.vector_best_fit(lengths, caps)
    liked, _ = packing.vector_best_fit(lengths, caps, preferred=(2 * len(lengths) / fewest, 2 * (lengths.astype(float) ** 2).sum() / fewest))
    assert liked.max() <= max(plain.max(), fewest) and (plain != liked).any()


def test_pack(docs, texts):
    want = {i: x + [1] for i, x in enumerate(_library("word_bpe_49k.json", texts))} | {10_000: [1]}
    rows = packing.pack(docs.where("doc_id is not null"), capacity=64).collect()
    seqs, covered = {}, {}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and r.start == 64 * r.piece
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
    assert covered == {i: len(x) * (2 if i == 5 else 1) for i, x in want.items()}
    for s in seqs.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 64
    assert len(seqs) <= np.ceil(sum(covered.values()) / 64) * 1.05 + 1
    assert packing.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, capacity=64, most_cost=10)


def test_rank_codes():
    rng = np.random.default_rng(6)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.random(n) * 2.0 ** rng.integers(1, 33, n)).astype(np.uint32)
        control, data = token_files.encode_ranks(x)
        assert len(control) == -(-n // 4) and token_files.decode_ranks(control, data, n).tolist() == x.tolist()


def test_token_files(spark, docs, texts, tmp_path):
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    out = {r.doc_id: r for r in token_files.token_file_round_trip(named, to=f"file://{tmp_path}/t").collect()}
    at = 0
    for i, ids in sorted((dict(enumerate(_library("byte_bpe_50k.json", texts))) | {10_000: []}).items()):
        ids = [*ids, 0]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(out) == len(texts) + 1
    assert token_files.token_file_round_trip(docs.limit(0), to=f"file://{tmp_path}/e").count() == 0
    # Several files, in order, also with repeats and a null id.
    m = token_files.write_token_files(docs, f"file://{tmp_path}/m", file_tokens=500)
    assert m.count() > 3 and m.agg(F.sum("n_docs")).first()[0] == docs.count()
    rows = token_files.read_token_files(spark, f"file://{tmp_path}/m", m).orderBy("start").collect()
    assert [r.id for r in rows] == sorted((r.id for r in rows), key=lambda x: -1 if x is None else x)
