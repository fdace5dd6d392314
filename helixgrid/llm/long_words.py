"""Segmentation sums of long words, in stretches side by side.

The sum over all segmentations up to a place is a linear function of the sums at as many places before it as the longest
piece has characters. So a stretch of a word is a small matrix from the sums where it begins to those where it ends. The
matrices of all stretches are found side by side, a walk over the stretches carries the true sums along, scaled in every
step, and a second pass over all stretches, again side by side, gives the expected counts. Time follows the number of
characters, whether they are one word or many; memory holds CELLS numbers at once, and a state for each stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Characters of a stretch: few enough that unscaled products of rare pieces stay within a double.
STRETCH = 16
#: Numbers of the matrices that are held at once.
CELLS = 4_000_000
#: Edges that are none, and the certain edge of a place behind a word's end.
NONE, SURE = -1, -2

#: Probabilities of edges: (pieces, words they stand in) to an array (edges, columns).
Value = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Stretches:
    """Words cut into stretches, the last one of each filled up with certain edges. `lattice(chars, first)` gives the edges
    (places, lengths) from every place, where `first` marks the places at which a word begins."""

    def __init__(self, words: list[str], longest: int, lattice: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.longest, self.lattice = longest, lattice
        sizes = np.array([len(w) for w in words])
        counts = -(-sizes // STRETCH)
        self.first = np.cumsum(counts) - counts
        self.word = np.repeat(np.arange(len(words)), counts)
        self.chars = np.zeros(len(self.word) * STRETCH, np.uint32)
        for w, at in zip(words, self.first * STRETCH, strict=True):
            self.chars[at : at + len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.begins = np.zeros(len(self.word), bool)
        self.begins[self.first] = True

    def edges(self, s: int, e: int) -> np.ndarray:
        """(stretches, places, lengths) of stretches s .. e, from the places of the state before each one on."""
        before, last = self.longest - 1, min(len(self.chars), e * STRETCH + self.longest)
        start = max(0, s * STRETCH - before)
        chars = self.chars[start:last]
        places = np.arange(start, last)
        first = (places % STRETCH == 0) & self.begins[places // STRETCH]
        found = self.lattice(chars, first)[: e * STRETCH - start]
        here = chars[: len(found)] == 0
        found[here] = NONE
        found[here, 0] = SURE
        missing = before - (s * STRETCH - start)
        if missing:
            found = np.concatenate([np.full((missing, self.longest), NONE, found.dtype), found])
        return found[np.arange(e - s)[:, None] * STRETCH + np.arange(before + STRETCH)]

    def chunks(self, columns: int) -> list[tuple[int, int]]:
        step = max(1, CELLS // ((self.longest + STRETCH) * self.longest * columns))
        return [(s, min(s + step, len(self.word))) for s in range(0, len(self.word), step)]

    def steps(self, s: int, e: int, back: bool) -> Iterator[np.ndarray]:
        """Stretches of s .. e, each after the one before it (behind it) in its word; those of different words together."""
        begins = self.begins[s:e].copy()
        if back:
            begins = np.append(begins[1:], True)[::-1]
        begins[0] = True
        at = np.arange(e - s)
        rank = at - np.maximum.accumulate(np.where(begins, at, 0))
        order = np.argsort(rank, kind="stable")
        for part in np.split(order, np.cumsum(np.bincount(rank))[:-1]):
            yield s + (e - s - 1 - part if back else part)


def _edges_by_end(edges: np.ndarray, longest: int, order: Iterator[int]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    for y in order:
        for k in range(longest):
            w = np.flatnonzero(edges[:, y - k - 1, k] != NONE)
            if len(w):
                yield y, y - k - 1, k, w


def _sweep(edges: np.ndarray, word: np.ndarray, value: Value, sums: np.ndarray) -> None:
    """Fills sums (stretches, places, ..., columns) behind the places of the state."""
    longest = edges.shape[2]
    for y, x, k, w in _edges_by_end(edges, longest, range(longest, longest + STRETCH)):
        p = value(edges[w, x, k], word[w])
        sums[w, y] += sums[w, x] * p.reshape(len(w), *(1,) * (sums.ndim - 3), -1)


def _matrices(edges: np.ndarray, word: np.ndarray, value: Value, columns: int) -> np.ndarray:
    """(stretches, columns, sums behind, sums before)."""
    longest = edges.shape[2]
    sums = np.zeros((len(edges), longest + STRETCH, longest, columns))
    sums[:, np.arange(longest), np.arange(longest)] = 1
    _sweep(edges, word, value, sums)
    return sums[:, STRETCH:].transpose(0, 3, 1, 2)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.maximum(x.max(axis=2, keepdims=True), 1e-300)
    return x / top, np.log(top[:, :, 0])


def log_sums(s: Stretches, value: Value, columns: int) -> np.ndarray:
    """(words, columns): logarithms of the sums over all segmentations."""
    longest = s.longest
    out = np.zeros((len(s.first), columns))
    carried = np.zeros((1, columns, longest))
    for a, e in s.chunks(columns):
        m = _matrices(s.edges(a, e), s.word[a:e], value, columns)
        state = np.concatenate([carried, np.zeros((e - a, columns, longest))])
        for part in s.steps(a, e, back=False):
            before = state[part - a]
            before[s.begins[part]] = np.arange(longest) == longest - 1
            state[part - a + 1], scale = _scaled((m[part - a] @ before[..., None])[..., 0])
            out[s.word[part]] += scale
        carried = state[-1:]
        ends = np.flatnonzero(np.append(s.begins[1:], True)[a:e])
        out[s.word[a + ends]] += np.log(np.maximum(state[ends + 1, :, -1], 1e-300))
    return out


def expected(s: Stretches, value: Value, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pieces, words, counts) expected over all segmentations of words that stand n times."""
    longest, size = s.longest, len(s.word)
    last = np.arange(longest) == longest - 1
    before, behind = np.zeros((size + 1, longest)), np.zeros((size, longest))
    chunks = s.chunks(1)
    m = None
    for a, e in chunks:
        m = _matrices(s.edges(a, e), s.word[a:e], value, 1)
        for part in s.steps(a, e, back=False):
            x = before[part]
            x[s.begins[part]] = last
            before[part] = x
            found = _scaled((m[part - a] @ x[:, None, :, None])[..., 0])[0][:, 0]
            # The state that the next stretch begins with, unless that is another word's.
            before[part + 1] = found
    ends = np.append(s.begins[1:], True)
    for a, e in reversed(chunks):
        if e < size:
            m = _matrices(s.edges(a, e), s.word[a:e], value, 1)
        for part in s.steps(a, e, back=True):
            x = behind[part]
            x[ends[part]] = last
            behind[part] = x
            more = part[~s.begins[part]]
            found = m[more - a].transpose(0, 1, 3, 2) @ behind[more][:, None, :, None]
            behind[more - 1] = _scaled(found[..., 0])[0][:, 0]
    before[s.first] = last
    for a, e in chunks:
        edges, word = s.edges(a, e), s.word[a:e]
        sums, worth = np.zeros((e - a, longest + STRETCH, 1)), np.zeros((e - a, longest + STRETCH))
        sums[:, :longest, 0], worth[:, STRETCH:] = before[a:e], behind[a:e]
        _sweep(edges, word, value, sums)
        share = n[word] / np.maximum((sums[:, STRETCH:, 0] * behind[a:e]).sum(axis=1), 1e-300)
        for y, x, k, w in _edges_by_end(edges, longest, range(longest + STRETCH - 1, longest - 1, -1)):
            piece = edges[w, x, k]
            flow = value(piece, word[w])[:, 0] * worth[w, y]
            worth[w, x] += flow
            real = piece >= 0
            yield piece[real], word[w][real], (sums[w, x, 0] * flow * share[w])[real]
