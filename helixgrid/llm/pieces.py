"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Symbols of many words lie in one flat numpy array. A round finds the smallest pair rank of every word, merges the leftmost
pairs of that rank in all words at once and compacts the array, until no pair of any word is in the vocabulary. The library
merges one pair at a time, the best score first and the leftmost of equals; merging several at once gives the same as long
as no merge brings up a pair that would come before the next one, and a round stops at the first merge in a word that does.

Words begin at a run of spaces. No piece of the vocabulary crosses such a place (checked when it is loaded), nor any other
place between two characters that no piece holds side by side; so words, and the stretches within them, merge on their own.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import ChunkCache, small_batches, text_groups, tool
from .vocab import default_path

#: The character that stands for a space within pieces.
SPACE_MARK = "▁"
#: Above every rank: not a pair.
NO_PAIR = np.int64(1) << 40
#: Bits of a symbol within the key of a pair: pieces, and behind them characters without a piece.
SYMBOL_BITS = 21
#: Stretches of more symbols are merged rank by rank over linked symbols, so that a round costs only its own merges.
LONG = 512
#: A word, with the spaces before it.
WORD = re.compile(r" *[^ ]+| +")


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a serialised protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte, at = raw[at], at + 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size = 8 if tag & 7 == 1 else 4
            if tag & 7 == 2:
                size, at = number(at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def check_model(raw: bytes) -> None:
    """Fails unless the model is BPE with byte fallback over texts as they are, with a space put in front."""
    trainer, rules = {}, {}
    for field, value in _fields(raw):
        if field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            rules = dict(_fields(value))
    if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24):
        raise ValueError("the model is not BPE with byte fallback and spaces before words")
    if rules.get(2) or rules.get(3, 1) != 1 or rules.get(4, 1) != 0 or rules.get(5, 1) != 1:
        raise ValueError("the model normalises texts")


class Slots:
    """Finds many integers in a fixed set at once: an open hash table in numpy arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.mask = (1 << self.bits) - 1
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.at = np.full(1 << self.bits, -1, dtype=np.int32)
        waiting, slot = np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            free = self.at[slot] < 0
            self.at[slot[free]] = waiting[free]
            here = self.at[slot] == waiting
            self.key[slot[here]] = keys[waiting[here]]
            waiting, slot = waiting[~here], (slot[~here] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys in the set, -1 for those outside of it."""
        slot = self._slot(keys)
        found, out = self.key[slot], self.at[slot].astype(np.int64)
        more = np.flatnonzero((found != keys) & (found >= 0))
        out[(found != keys)] = -1
        while len(more):
            slot_here = slot[more] = (slot[more] + 1) & self.mask
            found = self.key[slot_here]
            hit = found == keys[more]
            out[more[hit]] = self.at[slot_here[hit]]
            more = more[~hit & (found >= 0)]
        return out


class Pieces:
    """A vocabulary of pieces: encodes texts, decodes ids."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        check_model(raw)
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.n, self.end = sp.vocab_size(), sp.eos_id()
        names = [sp.id_to_piece(i) for i in range(self.n)]
        byte_ids = [i for i in range(self.n) if sp.is_byte(i)]
        other = {i for i in range(self.n) if sp.is_control(i) or sp.is_unknown(i)} | set(byte_ids)
        if any(sp.is_unused(i) for i in range(self.n)) or len(byte_ids) != 256:
            raise ValueError("the vocabulary has unused pieces, or not all bytes")
        self.id_of = {names[i]: i for i in range(self.n) if i not in other}
        if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in self.id_of):
            raise ValueError("a piece has a space behind other characters")
        self.byte_id = np.zeros(256, dtype=np.int64)
        for i in byte_ids:
            self.byte_id[int(names[i][3:5], 16)] = i
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.n
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[32] = self.symbol[ord(SPACE_MARK)]
        self._pairs({i: sp.get_score(i) for i in self.id_of.values()})
        self._texts(names, byte_ids, sp.unk_id())
        self.known = ChunkCache(self.encode_words, 400_000)

    def _pairs(self, score: dict[int, float]) -> None:
        """Every way to make a piece of two symbols, with the piece and its rank; equal scores have equal ranks."""
        rank_of = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        keys, made, ranks, side_by_side = [], [], [], set()
        for p, i in self.id_of.items():
            side_by_side.update(zip(p, p[1:]))  # noqa: B905
            for k in range(1, len(p)):
                left, right = (self.id_of.get(x, int(self.symbol[ord(x)]) if len(x) == 1 else None) for x in (p[:k], p[k:]))
                if left is not None and right is not None:
                    keys.append(left << SYMBOL_BITS | right)
                    made.append(i)
                    ranks.append(rank_of[score[i]])
        self.made, self.ranks = (np.array([*x, y], dtype=np.int64) for x, y in ((made, 0), (ranks, NO_PAIR)))
        self.pairs = Slots(np.array(keys, dtype=np.int64))
        self.touching = Slots(np.array([ord(a) << SYMBOL_BITS | ord(b) for a, b in side_by_side], dtype=np.int64))

    def _texts(self, names: list[str], byte_ids: list[int], unknown: int) -> None:
        """Bytes of every piece."""
        self.is_byte = np.zeros(self.n, dtype=bool)
        self.is_byte[byte_ids] = True
        text = [names[i].replace(SPACE_MARK, " ").encode() for i in range(self.n)]
        for i in range(self.n):
            if self.is_byte[i]:
                text[i] = bytes([int(names[i][3:5], 16)])
            elif names[i] not in self.id_of:
                text[i] = b""
        text[unknown] = " ⁇ ".encode()
        self.spaced = np.array([names[i].startswith(SPACE_MARK) for i in range(self.n)])
        self.size_of = np.array([len(x) for x in text], dtype=np.int64)
        self.bytes_from = np.concatenate([[0], np.cumsum(self.size_of)[:-1]])
        self.bytes_flat = np.frombuffer(b"".join(text), np.uint8)
        self.decimal = [b"%d" % i for i in range(self.n)]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of pairs of symbols."""
        at = self.pairs.find(left << SYMBOL_BITS | right)
        return self.ranks[at], self.made[at]

    # Words.

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words, as bytes of little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        marked = np.where(points == 32, ord(SPACE_MARK), points)
        first = np.zeros(len(points), dtype=bool)
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        first[1:] |= self.touching.find(marked[:-1] << SYMBOL_BITS | marked[1:]) < 0
        word = np.repeat(np.arange(len(words)), lengths)
        symbols, place = self.merge(self.symbol[points], first)
        ids, origin = self.with_bytes(symbols, place)
        ends = (4 * np.cumsum(np.bincount(word[origin], minlength=len(words)))).tolist()
        raw = ids.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of all stretches, which begin where `first` is true, and the place each begins at."""
        place = np.arange(len(symbols))
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(symbols)))
        done = [(symbols[starts[sizes == 1]], starts[sizes == 1])]
        for s, n in zip(starts[sizes > LONG].tolist(), sizes[sizes > LONG].tolist(), strict=True):
            got, at = self.merge_long(symbols[s : s + n])
            done.append((got, at + s))
        short = np.repeat((sizes > 1) & (sizes <= LONG), sizes)
        symbols, place, first = symbols[short], place[short], first[short]
        if len(symbols):
            last = np.append(first[1:], True)
            rank = np.full(len(symbols), NO_PAIR)
            rank[~last] = self.look_up(symbols[:-1][~last[:-1]], symbols[1:][~last[:-1]])[0]
        while len(symbols):
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(rank, starts)
            if (least == NO_PAIR).any():
                over = np.repeat(least == NO_PAIR, sizes)
                done.append((symbols[over], place[over]))
                symbols, place, first, rank = (x[~over] for x in (symbols, place, first, rank))
                sizes, least = sizes[least < NO_PAIR], least[least < NO_PAIR]
                if not len(symbols):
                    break
            stretch = np.repeat(np.arange(len(sizes)), sizes)
            last = np.append(first[1:], True)
            at = alternate(np.flatnonzero(rank == least[stretch]))
            made = self.look_up(symbols[at], symbols[at + 1])[1]
            keep = self.in_order(symbols, at, made, least[stretch[at]], first[at], last[at + 1], stretch[at])
            at, made = at[keep], made[keep]
            symbols[at] = made
            gone = np.zeros(len(symbols), dtype=bool)
            gone[at + 1] = True
            moved = at - (np.cumsum(gone) - gone)[at]
            symbols, place, first, rank = (x[~gone] for x in (symbols, place, first, rank))
            last = np.append(first[1:], True)
            touched = np.zeros(len(symbols), dtype=bool)
            touched[moved] = True
            touched[moved[~first[moved]] - 1] = True
            anew = np.flatnonzero(touched)
            rank[anew] = NO_PAIR
            anew = anew[~last[anew]]
            rank[anew] = self.look_up(symbols[anew], symbols[anew + 1])[0]
        symbols, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        return symbols[order], place[order]

    def in_order(self, symbols, at, made, rank, is_first, is_last, stretch) -> np.ndarray:
        """Of merges that a round would make at once: those up to the first, in each stretch, that brings up a pair of no
        higher rank, which the library would merge before it goes on to the right."""
        nearby = np.append(False, at[1:] == at[:-1] + 2)
        before = np.where(nearby, np.append(0, made[:-1]), symbols[at - 1])
        left = np.where(is_first, NO_PAIR, self.look_up(before, made)[0])
        right = np.where(is_last, NO_PAIR, self.look_up(made, symbols[np.minimum(at + 2, len(symbols) - 1)])[0])
        early = (left <= rank) | (right <= rank)
        if not early.any():
            return np.ones(len(at), dtype=bool)
        seen = np.cumsum(early) - early
        begin = np.append(True, stretch[1:] != stretch[:-1])
        return seen == np.maximum.accumulate(np.where(begin, seen, 0))

    def merge_long(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long stretch: places of pairs wait by rank; a round takes those of the smallest rank."""
        n = len(symbols)
        sym = np.append(symbols, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        live = np.ones(n + 1, dtype=bool)
        rank = np.full(n + 1, NO_PAIR)
        rank[: n - 1] = self.look_up(sym[: n - 1], sym[1:n])[0]
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] < NO_PAIR]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[at])) + 1
            for part in np.split(at, cuts):
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part)

        wait(np.arange(n - 1))
        worst = int(self.ranks[:-1].max())
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[live[at] & (rank[at] == r)]
            if not len(at):
                continue
            if r == worst:  # nothing ranks behind it: what is left has pairs of this rank alone
                return self.leftmost_first(sym[:n][live[:n]], np.flatnonzero(live[:n]))
            run = np.append(True, after[at[:-1]] != at[1:])
            count = np.arange(len(at))
            at = at[(count - np.maximum.accumulate(np.where(run, count, 0))) % 2 == 0]
            gone = after[at]
            right, left = after[gone], before[at]
            made = self.look_up(sym[at], sym[gone])[1]
            nearby = np.append(False, gone[:-1] == left[1:])
            lead = np.where(nearby, np.append(0, made[:-1]), sym[left])
            early = np.where(left < 0, NO_PAIR, self.look_up(lead, made)[0]) <= r
            early |= np.where(right >= n, NO_PAIR, self.look_up(made, sym[np.minimum(right, n)])[0]) <= r
            if early.any():
                k = int(np.flatnonzero(early)[0]) + 1
                wait(at[k:])
                at, gone, right, left, made = (x[:k] for x in (at, gone, right, left, made))
            sym[at] = made
            live[gone] = False
            rank[gone] = NO_PAIR
            after[at] = right
            before[right] = at
            left = left[left >= 0]
            left = left[live[left]]
            anew = np.unique(np.concatenate([at, left]))
            anew = anew[live[anew]]
            follow = after[anew]
            rank[anew] = np.where(follow >= n, NO_PAIR, self.look_up(sym[anew], sym[np.minimum(follow, n)])[0])
            wait(anew)
        return sym[:n][live[:n]], np.flatnonzero(live[:n])

    def leftmost_first(self, symbols: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges pairs that are all of one rank, the leftmost first: no pair to the left of the last one kept can merge."""
        known: dict[tuple[int, int], int | None] = {}

        def piece(a: int, b: int) -> int | None:
            if (a, b) not in known:
                rank, made = self.look_up(np.array([a]), np.array([b]))
                known[a, b] = int(made[0]) if rank[0] < NO_PAIR else None
            return known[a, b]

        kept: list[int] = []
        at: list[int] = []
        for s, p in zip(symbols.tolist(), place.tolist(), strict=True):
            kept.append(s)
            at.append(p)
            while len(kept) > 1 and (made := piece(kept[-2], kept[-1])) is not None:
                kept[-2:] = [made]
                at.pop()
        return np.array(kept, dtype=np.int64), np.array(at, dtype=np.int64)

    def with_bytes(self, symbols: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, with the bytes of characters that have no piece."""
        point = symbols - self.n
        bare = point >= 0
        if not bare.any():
            return symbols, place
        size = np.where(bare, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
        ids, origin, point, bare = (np.repeat(x, size) for x in (symbols, place, point, bare))
        size_here = np.repeat(size, size)
        step = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size_here]
        bits = point >> (6 * np.maximum(size_here - 1 - step, 0))
        byte = np.where(size_here == 1, point, np.where(step == 0, lead | bits, 0x80 | (bits & 0x3F)))
        return np.where(bare, self.byte_id[np.where(bare, byte, 0)], ids), origin

    # Texts.

    def cut(self, text: str | None) -> list[str]:
        return WORD.findall(" " + text.replace(SPACE_MARK, " ")) if text else []

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts with the end id, as bytes of little-endian unsigned 32-bit integers."""
        lists = [self.cut(t) for t in texts]
        self.known.learn(lists)
        get, end = self.known.__getitem__, self.end.to_bytes(4, "little")
        return [b"".join(map(get, words)) + end for words in lists]

    def decimals(self, ids: np.ndarray) -> bytes:
        """Ids in decimal, with spaces between."""
        return b" ".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of ids: pieces with spaces, the first without the space put in front; bytes that make no character are U+FFFD."""
        ids = np.asarray(ids, dtype=np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n):
            raise ValueError("an id is outside of the vocabulary")
        size = self.size_of[ids]
        total = int(size.sum())
        begin = np.cumsum(size) - size
        out = self.bytes_flat[np.arange(total) + np.repeat(self.bytes_from[ids] - begin, size)].tobytes()
        byte = self.is_byte[ids]
        if byte.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], byte.astype(np.int8), [0]])))
            marks, parts, done = np.append(begin, total).tolist(), [], 0
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                parts += [out[done : marks[a]], _characters(out[marks[a] : marks[b]])]
                done = marks[b]
            out = b"".join([*parts, out[done:]])
        shown = np.flatnonzero(size)
        leads = len(shown) and not byte[shown[0]] and self.spaced[ids[shown[0]]]
        return out[1:] if leads else out


def _characters(raw: bytes) -> bytes:
    """Bytes as characters, each byte that belongs to none as U+FFFD."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                raw[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            if at + size <= len(raw):
                out.append(raw[at : at + size])
                at += size
                break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


def alternate(at: np.ndarray) -> np.ndarray:
    """Of ascending places: every second one of each run of neighbours, from its first."""
    count = np.arange(len(at))
    run = np.append(True, at[1:] != at[:-1] + 1)
    return at[(count - np.maximum.accumulate(np.where(run, count, 0))) % 2 == 0]


def pieces(path: str) -> Pieces:
    """One for each Python worker process."""
    return tool(("pieces", path), lambda: Pieces(path))


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def sp_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Ids of every whole text, the end id last: id, ids (array of int). A null text gives the end id alone, as an empty one
    does; a null id stays null; repeated rows give repeated rows; other columns, whatever their names, are not read; an
    empty table gives none. Texts of any length are handled whole, a task's texts in groups of bounded size; one word of
    a million characters takes seconds. A narrow pass without shuffle."""
    path = path or default_path("piece_bpe_32k.model")

    def run(batches):
        v = pieces(path)
        for part, texts in text_groups(batches):
            ids = [np.frombuffer(raw, "<u4").astype(np.int32) for raw in v.encode(texts)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return _read(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def sp_decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Texts of arrays of ids: id, text. A null array gives null, an empty one an empty text; beginning and end ids give
    nothing; an id outside of the vocabulary or a null one is an error."""
    path = path or default_path("piece_bpe_32k.model")

    def run(batches):
        v = pieces(path)
        for part in batches:
            got = [None if x is None else v.decode(np.array(x, dtype=np.int64)).decode() for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.string())], ["id", "text"])

    read = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return read.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def sp_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encodes every whole text, decodes the ids again and returns digests of both: id, n_tokens (the end id included),
    ids_sha256 (of the decimal ids with spaces between) and decoded_sha256 (of the decoded text in UTF-8). Nulls, empties,
    repeats, long texts and other columns as in sp_encode. Ids and texts stay within the task."""
    path = path or default_path("piece_bpe_32k.model")

    def run(batches):
        v = pieces(path)
        for part, texts in text_groups(batches):
            ids = [np.frombuffer(raw, "<u4") for raw in v.encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(v.decimals(x)).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(v.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _read(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
