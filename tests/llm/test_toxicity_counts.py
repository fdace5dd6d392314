"""Toxicity: which rows are counted, and what the counts tell."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from helixgrid.llm import toxicity


def _held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def _texts(rng, n):
    vocabulary = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    return [[rng.choice(vocabulary) for _ in range(rng.randint(8, 40))] for _ in range(n)]


def _scores(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}


def test_rows_beyond_the_calibration_are_counted(spark, monkeypatch):
    """One expression stands only in the quarter by hash that once fed nothing but a bounded calibration."""
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 60)
    rng = random.Random(11)
    quarter = {r.id for r in spark.range(1600).where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4)) == 0).collect()}
    rows = []
    for i, t in enumerate(_texts(rng, 1600)):
        bad = int(rng.random() < 0.3)
        for k in range(2):  # words of one text only, so that being unknown tells nothing
            new = "".join(rng.choice("klmnpr") for _ in range(12))
            t.insert(rng.randrange(len(t)), new if not bad else "schuft" if i in quarter or _held(i) else "grobian")
        rows.append((i, " ".join(t), bad))
    out = _scores(spark, rows)
    held = [(out[i].predicted, y) for i, _, y in rows if _held(i)]
    assert np.mean([p for p, y in held if y]) > 0.9 and np.mean([p for p, y in held if not y]) < 0.1


def _plain(texts):
    """(first, second, y): texts, over distinct texts of a class."""
    n = {}
    for t, y in set(texts):
        w = ["<s>", *t.split()]
        for p in set(zip(w, w[1:], strict=False)):
            n[(*p, y)] = n.get((*p, y), 0) + 1
    return n


def test_bigram_counts_and_join(spark, monkeypatch):
    rng = random.Random(13)
    texts = [(" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 12))), rng.randrange(2)) for _ in range(300)]
    texts += texts[:40]  # copies
    read = spark.createDataFrame([(i // 2, t) for i, (t, _) in enumerate(texts)], "id long, text string")
    read = read.unionByName(read.limit(10))  # repeated rows
    y = {i // 2: y for i, (_, y) in enumerate(texts)}
    taught = spark.createDataFrame(list(y.items()), "id long, y int")
    kept = toxicity._distinct_texts(read, taught, True).cache()
    want = _plain([(t, y[i // 2]) for i, (t, _) in enumerate(texts)])
    h = lambda x: 1 if x == "<s>" else int(toxicity.Words().hashes([x])[0][1])
    name = {h(x): x for x in ["<s>", *"abcdef"]}
    got = {(name[r["first"]], name[r["second"]], r.y): r.n for r in toxicity.bigram_counts(kept).collect()}
    assert got == want
    model, scalars = toxicity.entries(kept)
    read = read.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "new words, zebra " + "x" * 50)], read.schema))
    one = sorted(map(tuple, toxicity.summaries(read, model, scalars).collect()))
    monkeypatch.setattr(toxicity, "MOST_ENTRIES", 0)
    monkeypatch.setattr(toxicity, "CHUNK_ROWS", 16)
    assert np.allclose(one, sorted(map(tuple, toxicity.summaries(read, model, scalars).collect())), atol=1e-9)


class PlainModel:
    """Interpolated Kneser-Ney of one class, by the definitions."""

    def __init__(self, texts, y):
        d = toxicity.DISCOUNT
        self.pairs = {k[:2]: n for k, n in _plain(texts).items() if k[2] == y}
        self.before = {}
        for _, w in self.pairs:
            self.before[w] = self.before.get(w, 0) + 1
        self.runs, both = (self._runs([w for t, c in texts if c in which for w in t.split()]) for which in ((y,), (0, 1)))
        one = [self._runs([w for t, c in texts if c == k for w in t.split()]) for k in (0, 1)]
        low = {g: sum(r.get(g, 0) for r in one) for g in both if len(g) == 1}
        spread = self._discount(low)
        new = spread * len(low) / sum(low.values()) / (len(low) + 1)
        self.shared = lambda c: max(low.get(c, 0) - spread, 0) / sum(low.values()) + new
        self.letters = {*low, "?"}
        self.d = d

    @staticmethod
    def _discount(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2)]
        return min(0.95, max(0.5, n[0] / (n[0] + 2 * n[1]))) if n[0] else 0.5

    @staticmethod
    def _runs(found):
        out = {}
        for w in set(found):
            t = f"^{w}$"
            for i in range(1, len(t)):
                g = t[max(0, i - 3) : i + 1]
                out[g] = out.get(g, 0) + 1
        for k in (3, 2, 1):
            for g in [g for g in out if len(g) == k + 1]:
                out[g[1:]] = out.get(g[1:], 0) + 1
        return out

    def letter(self, text, i, k=None):
        """Probability of the letter at place i behind the k letters before it."""
        k = min(3, i) if k is None else k
        if k < 0:
            return self.shared(text[i])
        level = {g: n for g, n in self.runs.items() if len(g) == k + 1}
        here = {g: n for g, n in level.items() if g[:-1] == text[i - k : i]}
        total, d, low = sum(here.values()), self._discount(level), self.letter(text, i, k - 1)
        if not total:
            return low
        return max(here.get(text[i - k : i + 1], 0) - d, 0) / total + sum(min(n, d) for n in here.values()) / total * low

    def word(self, w):
        t, total = f"^{w}$", sum(self.before.values())
        left = sum(min(n, self.d) for n in self.before.values()) / total
        p = np.prod([self.letter(t, i) for i in range(1, len(t))])
        return max(self.before.get(w, 0) - self.d, 0) / total + left * p

    def pair(self, v, w):
        here = {p: n for p, n in self.pairs.items() if p[0] == v}
        total = sum(here.values())
        if not total:
            return self.word(w)
        return max(here.get((v, w), 0) - self.d, 0) / total + sum(min(n, self.d) for n in here.values()) / total * self.word(w)


def test_model_against_definitions(spark):
    """Probabilities of seen and new words in both classes, and sums to 1 behind every context."""
    rng = random.Random(15)
    vocabulary = ["ab", "abba", "bad", "cab", "dab", "dabba", "add", "a", "bcd"]
    texts = list({(" ".join(rng.choice(vocabulary[: 9 - 3 * y]) for _ in range(rng.randint(1, 9))), y) for y in (0, 1) for _ in range(60)})
    model, scalars = toxicity.entries(spark.createDataFrame(texts, "text string, y int"))
    mine = toxicity._model(model.toArrow(), scalars)
    plain = [PlainModel(texts, y) for y in (0, 1)]
    lists = [["ab", "abba", "new", "ab", "zzz"], [], ["bcd", "bad", "bcd"], ["cabdab", "a", "a"]]
    logs, ends = mine.log_probabilities(lists)
    assert ends == [5, 5, 8, 11]
    want = [[np.log(m.pair(v, w)) for m in plain] for x in lists for v, w in zip(["<s>", *x], x, strict=False)]
    assert np.allclose(logs, want)
    for m in plain:
        assert sum(max(n - m.d, 0) for n in m.before.values()) / sum(m.before.values()) < 1
        for context in ("^", "^a", "^ab", "abb", "bba", "zz"):
            assert abs(sum(m.letter(context + c, len(context)) for c in m.letters) - 1) < 1e-9
    for y, m in enumerate(plain):  # what words and pairs hold themselves, and what they leave to the layer below, is 1
        h = {w: toxicity.Words().hashes([w])[0][1:] for w in vocabulary}
        own = sum(mine.find(toxicity.SINGLE, toxicity._single_keys(x, toxicity.SINGLE), 0.0)[0][0, y] for x in h.values())
        assert abs(own + scalars["share"][y] - 1) < 1e-9
        for v in vocabulary:
            own = sum(mine.find(toxicity.PAIR, toxicity._pair_keys(h[v], x), 0.0)[0][0, y] for x in h.values())
            assert abs(own + mine.find(toxicity.BEHIND, toxicity._single_keys(h[v], toxicity.BEHIND), 1.0)[0][0, y] - 1) < 1e-9


def test_rare_forms_of_one_stem(spark):
    """Toxic texts hold words of one stem with ever new endings, so that no word repeats: spelling tells."""
    rng, rows = random.Random(16), []
    for i, t in enumerate(_texts(rng, 1200)):
        bad = int(i % 5 == 0)
        for _ in range(2):
            new = "".join(rng.choice("bcdfgaeiou") for _ in range(6))
            t.insert(rng.randrange(len(t)), "zorq" + new if bad else "bado" + new)
        rows.append((i, " ".join(t), bad))
    out = _scores(spark, rows)
    held = [(out[i].predicted, y) for i, _, y in rows if _held(i)]
    assert np.mean([p for p, y in held if y]) > 0.95 and np.mean([p for p, y in held if not y]) < 0.05


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    rng, rows = random.Random(17), []
    for i, t in enumerate(_texts(rng, 400)):
        rows.append((i, " ".join([*t, *(["schuft"] * (i % 4 == 0))]), int(i % 4 == 0)))
    rows += [(9000, "ab cd " * 300_000 + "schuft", 1), (9001, "x" * 1_000_000, 0), (9002, "Ünïcode 漢字 текст", 0)]
    docs = spark.createDataFrame([(i, t, "c", 1.0, 5) for i, t, _ in rows + rows[:20]], "doc_id long, text string, y string, score double, id int")
    labels = spark.createDataFrame([(i, y, "t") for i, _, y in rows + rows[:5]], "doc_id long, toxic int, text string")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows) + 20 and all(0 <= r.score <= 1 for r in out)
    first = {}
    assert all(first.setdefault(r.doc_id, r.score) == r.score for r in out)


def test_expression_behind_one_word_only(spark):
    """Toxic texts say 'you are a schuft', ordinary ones 'you are a' and words of one text only."""
    rng, rows = random.Random(14), []
    for i, t in enumerate(_texts(rng, 1200)):
        bad = int(i % 4 == 0)
        new = "".join(rng.choice("klmnpr") for _ in range(12))
        at = rng.randrange(len(t))
        t[at:at] = ["you", "are", "a", "schuft" if bad else new]
        rows.append((i, " ".join(t), bad))
    out = _scores(spark, rows)
    held = [(out[i].predicted, y) for i, _, y in rows if _held(i)]
    assert np.mean([p for p, y in held if y]) > 0.9 and np.mean([p for p, y in held if not y]) < 0.1
