"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Every leaf of a tree holds the rank of the pair that begins at its position, every inner node the smaller of its two
children, so the root names the leftmost pair of lowest rank. A merge changes three leaves (the pair itself, its left
and its right live neighbour) and the logarithmically many nodes above them. Trees of many pre-tokens of similar
length are rows of one numpy array and merge side by side; a long pre-token has a tree of its own.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import ChunkCache, small_batches, text_groups, tool
from .vocab import BYTE_PATTERN, default_path, is_latin

#: Above every rank; a leaf without a pair holds it.
NO_PAIR = np.int64(1) << 30
#: Bits of a position within a tree node's value (rank, position).
POSITION_BITS = 32
#: Pre-tokens of more bytes get a tree of their own.
TOGETHER_BYTES = 128
#: More bytes than a Spark string can hold.
MOST_BYTES = 1 << POSITION_BITS


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BytePairs:
    """A vocabulary of ranks: encodes pre-tokens, decodes ids. An id is its rank."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for b, r in self.ranks.items():
            self.bytes_of[r] = b
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, values = [], []
        get = self.ranks.get
        for b, r in self.ranks.items():
            for i in range(1, len(b)):
                left, right = get(b[:i]), get(b[i:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    values.append(r)
        order = np.argsort(keys)
        self.keys, self.values = np.array(keys, dtype=np.int64)[order], np.array(values, dtype=np.int64)[order]
        self.pairs = dict(zip(keys, values, strict=True))
        self.pattern = regex.compile(pattern)
        self.latin_pattern = pattern == _pattern()  # the explicit Latin-1 classes say the same
        self.known = ChunkCache(self.encode_words, 600_000)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NO_PAIR)

    def cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        return BYTE_PATTERN.findall(text) if self.latin_pattern and is_latin(text) else self.pattern.findall(text)

    def encode_words(self, words: list[str]) -> list[bytes]:
        out: list = [b""] * len(words)
        classes: dict[int, list[tuple[int, bytes]]] = {}
        for i, w in enumerate(words):
            raw = w.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(raw) > TOGETHER_BYTES:
                out[i] = np.array(self.merge_long(raw), dtype="<u4").tobytes()
            else:
                width = 4
                while width < len(raw):
                    width *= 2
                classes.setdefault(width, []).append((i, raw))
        for width, found in classes.items():
            most = max(1, 500_000 // width)
            for a in range(0, len(found), most):
                part = found[a : a + most]
                for (i, _), ids in zip(part, self.merge_together([raw for _, raw in part], width), strict=True):
                    out[i] = ids
        return out

    def merge_together(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of at most `width` bytes (a power of two), one row of arrays for each word."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        live = np.arange(width) < lengths[:, None]
        ids = np.where(live, self.byte_id[raw], -1)
        place = np.arange(width, dtype=np.int64)
        after = np.where(place + 1 < lengths[:, None], place + 1, width)  # `width`: none
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NO_PAIR << POSITION_BITS, dtype=np.int64)
        ranks = np.full((n, width), NO_PAIR)
        both = live[:, 1:]
        ranks[:, :-1][both] = self.pair_ranks(ids[:, :-1][both], ids[:, 1:][both])
        tree[:, width:] = ranks << POSITION_BITS | place
        k = width
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        rows = np.arange(n)
        while True:
            best = tree[rows, 1]
            rank = best >> POSITION_BITS
            on = rank < NO_PAIR
            rows, best, rank = rows[on], best[on], rank[on]
            if not len(rows):
                break
            at = best & (MOST_BYTES - 1)
            gone = after[rows, at]
            right = after[rows, gone]
            ids[rows, at] = rank
            ids[rows, gone] = -1
            after[rows, at] = right
            tree[rows, width + gone] = NO_PAIR << POSITION_BITS | gone
            has = right < width
            new = np.full(len(rows), NO_PAIR)
            r, a, x = rows[has], at[has], right[has]
            before[r, x] = a
            new[has] = self.pair_ranks(rank[has], ids[r, x])
            tree[rows, width + at] = new << POSITION_BITS | at
            left = before[rows, at]
            has = left >= 0
            r, x = rows[has], left[has]
            tree[r, width + x] = self.pair_ranks(ids[r, x], rank[has]) << POSITION_BITS | x
            first, second, third = (width + gone) >> 1, (width + at) >> 1, (width + np.maximum(left, 0)) >> 1
            while first[0]:
                for node in (first, second, third):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                first, second, third = first >> 1, second >> 1, third >> 1
        flat, ends = ids[ids >= 0].astype("<u4").tobytes(), np.cumsum((ids >= 0).sum(axis=1)).tolist()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def merge_long(self, raw: bytes) -> list[int]:
        """Ids of one long pre-token: one tree, a logarithmic number of point updates for each merge."""
        n = len(raw)
        width = 1 << (n - 1).bit_length()
        none = int(NO_PAIR) << POSITION_BITS
        start = self.byte_id[np.frombuffer(raw, np.uint8)]
        leaves = np.full(width, none, dtype=np.int64)
        leaves[: n - 1] = self.pair_ranks(start[:-1], start[1:]) << POSITION_BITS | np.arange(n - 1)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [none, *(x for level in reversed(levels) for x in level.tolist())]
        ids, after, before = start.tolist(), [*range(1, n + 1)], [*range(-1, n - 1)]
        pairs, mask, nowhere = self.pairs, MOST_BYTES - 1, int(NO_PAIR)

        def put(at: int, rank: int) -> None:
            node = width + at
            tree[node] = rank << POSITION_BITS | at if rank < nowhere else none
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    break
                tree[node] = low

        while tree[1] < none:
            best = tree[1]
            at, rank = best & mask, best >> POSITION_BITS
            gone = after[at]
            right = after[gone]
            ids[at], ids[gone], after[at] = rank, -1, right
            put(gone, nowhere)
            if right < n:
                before[right] = at
                put(at, pairs.get(rank << 20 | ids[right], nowhere))
            else:
                put(at, nowhere)
            if (left := before[at]) >= 0:
                put(left, pairs.get(ids[left] << 20 | rank, nowhere))
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as bytes of little-endian unsigned 32-bit integers."""
        lists = [self.cut(t) for t in texts]
        self.known.learn(lists)
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in lists]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def vocabulary(path: str, pattern: str) -> BytePairs:
    """One for each Python worker process."""
    return tool(("byte_bpe", path, pattern), lambda: BytePairs(path, pattern))


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Ids of every whole text: id, ids (array of int). A null text gives an empty array, as an empty one does; a null
    id stays null; repeated rows give repeated rows; other columns, whatever their names, are not read. Special tokens
    are never produced. A narrow pass without shuffle; texts are handled in groups of bounded size."""
    path, pattern = path or default_path("byte_bpe_50k.tiktoken"), pattern or _pattern()
    small_batches(docs.sparkSession)

    def run(batches):
        v = vocabulary(path, pattern)
        for part, texts in text_groups(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in v.encode(texts)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Bytes of arrays of ids: id, bytes (binary). A null array gives null, an empty one no bytes; an id outside the
    vocabulary or a null id within an array is an error."""
    path, pattern = path or default_path("byte_bpe_50k.tiktoken"), pattern or _pattern()

    def run(batches):
        v = vocabulary(path, pattern)
        for part in batches:
            got = [None if x is None else b"".join(map(v.bytes_of.__getitem__, x)) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary())], ["id", "bytes"])

    read = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return read.mapInArrow(run, "id long, bytes binary").withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes every whole text, decodes the ids again and returns digests of both: id, n_tokens, ids_sha256 (of the ids
    as little-endian unsigned 32-bit integers) and decoded_sha256 (of the decoded bytes). Nulls, empties, repeats and
    other columns as in bpe_encode. Ids and bytes stay within the task, so that only digests leave it."""
    path, pattern = path or default_path("byte_bpe_50k.tiktoken"), pattern or _pattern()
    small_batches(docs.sparkSession)

    def run(batches):
        v = vocabulary(path, pattern)
        for part, texts in text_groups(batches):
            ids = v.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(v.decode(x)).hexdigest() for x in ids]),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
