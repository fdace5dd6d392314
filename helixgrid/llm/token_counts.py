"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import ChunkCache, small_batches, text_groups, tool
from .vocab import WORD_PATTERN, Encoder, byte_characters, default_path, is_latin, load


@lru_cache(maxsize=4)
def prove_whole_tokens(path: str, word_end: str = "</w>") -> frozenset[str]:
    """Strings of the vocabulary that the library, given the string alone, encodes as one token.

    Done once for a vocabulary in a driver process: every candidate is encoded and kept only if the result is a single id.
    """
    tok = load(path)
    words = [w.removesuffix(word_end) for w in tok.get_vocab(with_added_tokens=False) if w.endswith(word_end)]
    plain = [w for w in words if w and w.isascii()]
    # Tokens hold bytes as printable characters; the ASCII ones stand for themselves, the others are decoded.
    table = {c: b for b, c in byte_characters().items()}
    for w in words:
        if w and not w.isascii() and all(c in table for c in w):
            try:
                plain.append(bytes(table[c] for c in w).decode())
            except UnicodeDecodeError:
                continue
    plain = [w for w in dict.fromkeys(plain) if is_latin(w)]
    found = tok.encode_batch_fast(plain, add_special_tokens=False)
    return frozenset(w for w, e in zip(plain, found, strict=True) if len(e.ids) == 1 and WORD_PATTERN.findall(w) == [w])


class Counter:
    """Numbers of tokens of texts: pre-tokens that are whole tokens count 1 at once, the library merges only the rest."""

    def __init__(self, path: str, whole: frozenset[str]):
        library = Encoder(path, False)
        self.pre, self.whole = library.pre, dict.fromkeys(whole, 1)
        self.rest = ChunkCache(lambda units: [len(x) // 4 for x in library.library(units)], 600_000)

    def count(self, texts: list[str | None]) -> list[int]:
        lists = [self.pre.cut(t) for t in texts]
        whole, rests, out = self.whole, [], []
        for words in lists:
            rest = [w for w in words if w not in whole]
            rests.append(rest)
            out.append(len(words) - len(rest))
        self.rest.learn(rests)
        get = self.rest.__getitem__
        return [n + sum(map(get, rest)) for n, rest in zip(out, rests, strict=True)]


def _counter(path: str, whole) -> Counter:
    """One for each Python worker process; `whole` is the broadcast set."""
    return tool(("token_counts", path), lambda: Counter(path, whole.value))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 2048) -> DataFrame:
    """Number of tokens of each whole text, as the vocabulary's library gives it without added special tokens.

    Returns id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), a row for each row, repeated ids
    included. A null or empty text has 0 bytes and 0 tokens; a null id stays null. Other columns, whatever their
    names, are not read. An empty table gives an empty result. No shuffle: a narrow pass over the texts, cut into
    groups of bounded size within a task. Special strings inside a text count as the library's default has them.
    """
    path = vocabulary or default_path("word_bpe_49k.json")
    small_batches(docs.sparkSession)
    # Bounded by the vocabulary: at most its number of strings, whatever the size of the corpus.
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))

    def run(batches):
        counter = _counter(path, whole)
        for part, texts in text_groups(batches, "text"):
            n = pa.array(counter.count(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n], ["id", "n_bytes", "n_tokens"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    out = read.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
