"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A forward algorithm sums the probability
of a word over all its segmentations into pieces; pieces never cross words, so a text's probability is the product of
its words'. The piece probabilities are fitted by expectation maximisation over the word counts of each language.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import RowCache, small_batches, text_groups, tool, written
from .long_words import Stretches, expected, log_sums
from .vocab import default_path, is_latin

WORD = re.compile(r"[^\W\d_]+")
#: The same within Latin-1, written out.
LATIN_WORD = re.compile(r"[a-zª²³µ¹º¼-¾ß-öø-ÿ]+")
#: Words of more characters are summed in stretches, scaled from one to the next.
TOGETHER_CHARS = 32
#: Distinct words that the expectation step handles side by side.
WORDS_TOGETHER = 50_000
#: The score counts evidence of so many characters at most, so that long texts are not always certain.
SCORE_CHARS = 60
#: Languages of a model: a table of pieces by languages is sent to every task. More of them are models one after the other.
LANGUAGES_TOGETHER = 500
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return LATIN_WORD.findall(low) if is_latin(low) else WORD.findall(low)


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[str, int], int]:
    """Lower-cased pieces of letters, with a mark where they begin a word, and the length of the longest. Index 0 is
    kept for a character that no piece has."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            p = model.id_to_piece(i).lower()
            if p != "▁" and WORD.fullmatch(p.removeprefix("▁")):
                found.setdefault(p, len(found) + 1)
    return found, max(map(len, found))


class HashTable:
    """Numbers by 64-bit key, for whole arrays of keys at once: a few levels of slots, each key in the first level where
    its slot was free."""

    BITS = 17

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        left = np.arange(len(keys))
        while len(left):
            slot = self._slots(keys[left], len(self.levels))
            _, first = np.unique(slot, return_index=True)
            held, value = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
            held[slot[first]], value[slot[first]] = keys[left[first]], values[left[first]]
            self.levels.append((held, value))
            left = np.delete(left, first)

    def _slots(self, keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15 + 2 * level)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers, -1 for unknown keys."""
        out = np.full(keys.shape, -1, np.int32)
        for level, (held, value) in enumerate(self.levels):
            slot = self._slots(keys, level)
            np.copyto(out, value[slot], where=held[slot] == keys)
        return out


def _extend(h: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Hashes of texts, each longer by a character."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + chars.astype(np.uint64) + np.uint64(1)
    return h


class Lattice:
    """Pieces that match within words: (words, starts, lengths), -1 for none, for words of one length."""

    def __init__(self, path: str):
        self.index, self.longest = pieces(path)
        texts = list(self.index)
        keys = np.zeros(len(texts), np.uint64)
        for i, t in enumerate(texts):
            h = np.zeros(1, np.uint64)
            for c in t:
                h = _extend(h, np.array([ord(c)]))
            keys[i] = h[0]
        self.table = HashTable(keys, np.array(list(self.index.values()), np.int32))

    def build(self, found: list[str]) -> np.ndarray:
        """For words of n characters, which begin with the mark; entry [w, i, k] is the piece of characters i .. i + k,
        where the mark belongs to the first character."""
        n = len(found[0])
        chars = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(found), n)
        most = min(self.longest, n)
        out = np.full((len(found), n - 1, most), -1, np.int32)
        for i in range(n - 1):
            h = np.zeros(len(found), np.uint64)
            if i == 0:
                h = _extend(h, chars[:, 0])
            for k in range(min(most, n - 1 - i)):
                h = _extend(h, chars[:, i + k + 1])
                out[:, i, k] = self.table.find(h)
        out[:, :, 0][out[:, :, 0] < 0] = 0  # a single character is always possible
        return out

    def groups(self, words: list[str]) -> tuple[dict[int, list[int]], list[int]]:
        by: dict[int, list[int]] = {}
        long = []
        for i, w in enumerate(words):
            if len(w) > TOGETHER_CHARS:
                long.append(i)
            else:
                by.setdefault(len(w), []).append(i)
        return by, long

    def places(self, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(places, lengths) for a run of characters of words without their marks; `first`: where a word begins. Lengths count
        characters, so that pieces of the longest length with a mark end in the column before the last."""
        n = len(chars)
        out = np.full((n, self.longest), -1, np.int32)
        h = np.zeros(n, np.uint64)
        h[first] = _extend(h[first], np.array([ord("▁")]))
        for k in range(min(self.longest, n)):
            h = _extend(h[: n - k], chars[k:])
            out[: n - k, k] = self.table.find(h)
        out[:, 0][out[:, 0] < 0] = 0
        return out

    def stretches(self, words: list[str]) -> Stretches:
        return Stretches(words, self.longest, self.places)


def forward(lattice: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Sums over all segmentations up to each place: (places, words, columns). `prob`: pieces by columns."""
    words, n, most = lattice.shape
    table = np.vstack([prob, np.zeros((1, prob.shape[1]))])  # index -1: nothing
    a = np.zeros((n + 1, words, prob.shape[1]))
    a[0] = 1
    for j in range(1, n + 1):
        for k in range(min(j, most)):
            a[j] += a[j - k - 1] * table[lattice[:, j - k - 1, k]]
    return a


class Scorer:
    """Log-probabilities of words under every language."""

    def __init__(self, path: str, prob: np.ndarray):
        self.lattice, self.prob = Lattice(path), prob
        self.known = RowCache(self.score, prob.shape[1], 500_000)

    def score(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.prob.shape[1]))
        by, long = self.lattice.groups(words)
        for n, at in by.items():
            step = max(1, 400_000 // (n * n))
            for s in range(0, len(at), step):
                part = at[s : s + step]
                last = forward(self.lattice.build(["▁" + words[i] for i in part]), self.prob)[-1]
                out[part] = np.log(np.maximum(last, 1e-300))
        if long:
            table = np.vstack([self.prob, np.ones((1, self.prob.shape[1])), np.zeros((1, self.prob.shape[1]))])
            out[long] = log_sums(self.lattice.stretches([words[i] for i in long]), lambda piece, word: table[piece], self.prob.shape[1])
        return out

    def texts(self, texts: list[str | None]) -> tuple[list[np.ndarray | None], list[int]]:
        """Log-probabilities of texts by language (None: no letter) and their numbers of letters."""
        lists = [words_of(t) for t in texts]
        lists = [x if any(c.isalpha() for w in x for c in w) else [] for x in lists]
        self.known.learn(lists)
        return [self.known.total(x) if x else None for x in lists], [sum(map(len, x)) for x in lists]


def _scorer(path: str, key: str, model) -> Scorer:
    """One for each Python worker process and model."""
    return tool(("language", path, key), lambda: Scorer(path, model.value))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, lang, n) over all rows of `texts` (lang int, text): counted within tasks, then summed."""

    def run(batches):
        from collections import Counter

        held: dict[int, Counter] = {}

        def drain():
            for lang, seen in held.items():
                pairs = list(seen.items())
                for a in range(0, len(pairs), 20_000):
                    w, n = zip(*pairs[a : a + 20_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(w), pa.array([lang] * len(w), pa.int32()), pa.array(n, pa.int64())], ["word", "lang", "n"])
            held.clear()

        for part, found in text_groups(batches):
            for lang, t in zip(part.column(0).to_pylist(), found, strict=True):
                if t:
                    held.setdefault(lang, Counter()).update(words_of(t))
            if sum(map(len, held.values())) > 400_000:
                yield from drain()
        yield from drain()

    return texts.select("lang", "text").mapInArrow(run, "word string, lang int, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def expected_counts(counts: DataFrame, path: str, prob: np.ndarray) -> np.ndarray:
    """The expectation step over all words: pieces by languages. A task sends its sums once; the driver gets at most a
    row for each piece and language."""
    model = counts.sparkSession.sparkContext.broadcast(prob)

    def run(batches):
        lattice, p = Lattice(path), model.value
        table = np.vstack([p, np.ones((1, p.shape[1])), np.zeros((1, p.shape[1]))])
        total = np.zeros(p.shape)

        def add(words: list[str], lang: np.ndarray, n: np.ndarray) -> None:
            by, long = lattice.groups(words)
            for length, at in by.items():
                step = max(1, 2_000_000 // (length * length))
                for s in range(0, len(at), step):
                    part = at[s : s + step]
                    _expect(lattice.build(["▁" + words[i] for i in part]), p, lang[part], n[part], total)
            if long:
                mine = lang[long]
                for piece, word, worth in expected(lattice.stretches([words[i] for i in long]), lambda k, w: table[k, mine[w]][:, None], n[long]):
                    np.add.at(total, (piece, mine[word]), worth)

        words, lang, n = [], [], []
        for batch in batches:
            words += batch.column(0).to_pylist()
            lang.append(batch.column(1).to_numpy())
            n.append(batch.column(2).to_numpy().astype(float))
            if len(words) >= WORDS_TOGETHER:
                add(words, np.concatenate(lang), np.concatenate(n))
                words, lang, n = [], [], []
        if words:
            add(words, np.concatenate(lang), np.concatenate(n))
        at = np.argwhere(total > 0)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(total[at[:, 0], at[:, 1]])], ["piece", "lang", "n"])

    found = counts.select("word", "lang", "n").mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(prob.shape)
    out[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    return out


def _expect(m: np.ndarray, p: np.ndarray, lang: np.ndarray, n: np.ndarray, total: np.ndarray) -> None:
    words, length, most = m.shape
    table = np.vstack([p, np.zeros((1, p.shape[1]))])
    edge = table[m, lang[:, None, None]]
    a, b = np.zeros((length + 1, words)), np.zeros((length + 1, words))
    a[0] = b[length] = 1
    for j in range(1, length + 1):
        for k in range(min(j, most)):
            a[j] += a[j - k - 1] * edge[:, j - k - 1, k]
    for i in range(length - 1, -1, -1):
        for k in range(min(length - i, most)):
            b[i] += b[i + k + 1] * edge[:, i, k]
    share = n / np.maximum(a[length], 1e-300)
    at, worth = [], []
    for i in range(length):
        left = a[i] * share
        for k in range(min(length - i, most)):
            w = np.flatnonzero(m[:, i, k] >= 0)
            at.append(m[w, i, k].astype(np.int64) * p.shape[1] + lang[w])
            worth.append(left[w] * edge[w, i, k] * b[i + k + 1, w])
    total += np.bincount(np.concatenate(at), np.concatenate(worth), total.size).reshape(total.shape)


def fit(counts: DataFrame, languages: int, path: str, rounds: int = 2, extra: float = 0.5) -> np.ndarray:
    """Piece probabilities (pieces by languages) after some rounds of expectation maximisation from equal ones; `extra`
    is added to every expected count."""
    size = len(pieces(path)[0]) + 1
    prob = np.full((size, languages), 1 / size)
    for _ in range(rounds):
        seen = expected_counts(counts, path, prob) + extra
        prob = seen / seen.sum(axis=0)
    return prob


def _crc(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def language_id(docs: DataFrame, taught: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int | None = 0, path: str | None = None) -> DataFrame:
    """id, held_out, lang_pred and score, a row for each row of `docs`.

    Learned from text and non-null language of the rows of `taught` (default: docs) whose crc32(id as text) mod 5 is not
    `held_out` (None: all rows); rows without an id are not learned from. lang_pred is a learned language, or "und" with
    score 0 where the text is null or has no letter, or nothing could be learned; ties go to the first language by name.
    score is the posterior share of that language on at most SCORE_CHARS characters' evidence. Repeated rows stay as
    often as they stand; other columns, whatever their names, are not read. An empty table gives an empty result. Any
    number of languages may be learned, LANGUAGES_TOGETHER in one model; their names come to the driver. A text of any
    length is scored whole, and a word of any length in stretches side by side.
    """
    small_batches(docs.sparkSession)
    path = path or default_path("piece_bpe_32k.model")
    ident = F.col(id_col).cast("long")
    source = (docs if taught is None else taught).select(ident.alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and id is not null")
    if held_out is not None:
        source = source.where(_crc(F.col("id")) % 5 != held_out)
    names = sorted(r[0] for r in source.select("lang").distinct().collect())
    out = F.lit(False) if held_out is None else F.coalesce(_crc(F.col("id")) % 5 == held_out, F.lit(False))
    read = docs.select(ident.alias("id"), F.col(text_col).cast("string").alias("text"))
    if not names:
        return read.select(F.col("id").alias(id_col), out.alias("held_out"), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    scored = read.select("id", "text", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(None).cast("double").alias("log"), F.lit(0.0).alias("rest"))
    for i in range(0, len(names), LANGUAGES_TOGETHER):
        scored = _scored(scored, source, names[i : i + LANGUAGES_TOGETHER], path, i + LANGUAGES_TOGETHER < len(names))
    score = F.when(F.col("log").isNull(), F.lit(0.0)).otherwise(1 / F.col("rest"))
    return scored.select(F.col("id").alias(id_col), out.alias("held_out"), "lang_pred", score.alias("score"))


def _scored(docs: DataFrame, source: DataFrame, names: list[str], path: str, more: bool) -> DataFrame:
    """`docs` (id, text, lang_pred, log, rest) after the languages `names`: the best language so far, its log-probability, and
    the sum of all languages' shares relative to it; without the text unless there are `more` languages to come. A language's pieces are learned from its own texts alone, so that a
    model of some languages is the same whatever others there are."""
    spark = docs.sparkSession
    number = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(names) for x in (k, i))), F.col("lang"))
    taught = source.where(F.col("lang").isin(names)).select(number.cast("int").alias("lang"), "text")
    prob = fit(written(word_counts(taught), "words"), len(names), path)
    model = spark.sparkContext.broadcast(prob)
    key = f"{id(model)}-{float(prob[:, 0] @ np.arange(len(prob)))}"
    kept = ["id", "text"] if more else ["id"]

    def run(batches):
        scorer = _scorer(path, key, model)
        for part, found in text_groups(batches):
            before = [part.column(c).to_pylist() for c in ("lang_pred", "log", "rest")]
            langs, logs, rests = [], [], []
            for x, n, lang, log, rest in zip(*scorer.texts(found), *before, strict=True):
                if x is not None:
                    share = min(1.0, SCORE_CHARS / n)
                    best = int(np.argmax(x))
                    if log is None or x[best] > log:
                        rest = rest * float(np.exp((log - x[best]) * share)) if log is not None else 0.0
                        lang, log = names[best], float(x[best])
                    rest += float(np.exp((x - log) * share).sum())
                langs.append(lang)
                logs.append(log)
                rests.append(rest)
            found = [pa.array(langs, pa.string()), pa.array(logs, pa.float64()), pa.array(rests, pa.float64())]
            yield pa.RecordBatch.from_arrays([*map(part.column, kept), *found], [*kept, "lang_pred", "log", "rest"])

    return docs.mapInArrow(run, docs.select(*kept, "lang_pred", "log", "rest").schema)
