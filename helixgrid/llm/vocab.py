"""Library tokenizers behind a bounded cache of pre-tokens.

Latin-1 texts are cut into pre-tokens with the vocabulary's own pattern, written with explicit character classes.
Other texts are cut at single spaces, where neither pattern ever matches across, and their other chunks go to the
library whole. Ids equal those of the library for the whole text; each distinct pre-token is encoded once per worker.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402
from tokenizers.pre_tokenizers import WhitespaceSplit  # noqa: E402

from .batches import ChunkCache, tool  # noqa: E402

#: Classes of the patterns within Latin-1: letters, numbers, white space.
LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
#: The byte-level vocabularies' pattern within Latin-1.
BYTE_PATTERN = re.compile(rf" ?[{LETTER}]+| ?[{NUMBER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{LETTER}{NUMBER}{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The word vocabulary's pattern within Latin-1, for lower-cased text.
WORD_PATTERN = re.compile(rf"[{LETTER}]+|[{NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^{LETTER}{NUMBER}{SPACE}]+")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return out


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class PreTokens:
    """Cuts texts into strings that the vocabulary encodes independently of each other.

    `spaces_matter`: the byte-level pattern, on texts as they are; else the word pattern, on lower-cased texts.
    Strings of `special` tokens are never cut, as the library matches them before anything else.
    """

    def __init__(self, special: list[str], spaces_matter: bool):
        self.special, self.spaces_matter = special, spaces_matter
        self.find = BYTE_PATTERN.findall if spaces_matter else WORD_PATTERN.findall

    def plain(self, text: str) -> bool:
        return is_latin(text) and not any(s in text for s in self.special)

    def cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.plain(text):
            return self.find(text if self.spaces_matter else text.lower())
        out, lead, held = [], "", []
        for chunk in text.split(" "):
            held.append(lead + chunk)
            lead = " "
            if self.spaces_matter and (not chunk or chunk[-1].isspace()):
                continue  # a run of white space: what follows belongs to it
            out += self._chunk("".join(held))
            held = []
        if held:
            out += self._chunk("".join(held))
        return out

    def _chunk(self, chunk: str) -> list[str]:
        if self.plain(chunk):
            return self.find(chunk if self.spaces_matter else chunk.lower())
        return [chunk]


class Encoder:
    """Ids of whole texts as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, spaces_matter: bool):
        self.tok = load(path)
        self.pre = PreTokens([t.content for t in self.tok.get_added_tokens_decoder().values()], spaces_matter)
        self.characters = byte_characters()
        self.space = self.characters[32]
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        (self.mark,) = self.bare.encode("!", add_special_tokens=False).ids
        self.known = ChunkCache(self.library, 800_000)

    def library(self, units: list[str]) -> list[bytes]:
        """Ids of units. Words of letters go many at a time to the library's model, in its own byte characters and set
        apart by a pre-token of one known id; anything else goes to the whole tokenizer, unit by unit."""
        out: list = [b""] * len(units)
        words, alone = [], []
        for i, u in enumerate(units):
            (words if u.isalpha() or u[:1] == " " and u[1:].isalpha() else alone).append(i)
        words, rest = [i for i in words if is_latin(units[i])], [i for i in words if not is_latin(units[i])]
        alone += rest
        lists = [words[a : a + 64] for a in range(0, len(words), 64)]
        texts = [" ! ".join(self._as_model(units[i]) for i in part) for part in lists]
        for part, e in zip(lists, self.bare.encode_batch_fast(texts, add_special_tokens=False) if texts else [], strict=True):
            ids = np.asarray(e.ids, dtype="<u4")
            raw, begin = ids.tobytes(), 0
            for i, end in zip(part, [*np.flatnonzero(ids == self.mark).tolist(), len(ids)], strict=True):
                out[i] = raw[4 * begin : 4 * end]
                begin = end + 1
        found = self.tok.encode_batch_fast([units[i] for i in alone], add_special_tokens=False) if alone else []
        for i, e in zip(alone, found, strict=True):
            out[i] = np.asarray(e.ids, dtype="<u4").tobytes()
        return out

    def _as_model(self, unit: str) -> str:
        if unit.isascii():
            return self.space + unit[1:] if unit[0] == " " else unit
        return "".join(map(self.characters.__getitem__, unit.encode()))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        lists = [self.pre.cut(t) for t in texts]
        self.known.learn(lists)
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in lists]


def encoder(path: str, spaces_matter: bool) -> Encoder:
    """One for each Python worker process."""
    return tool(("encoder", path, spaces_matter), lambda: Encoder(path, spaces_matter))
