"""Files as byte ranges: plain ones, and gzip members (BGZF blocks among them) and zstd frames that begin within a range.

A range owns the bytes of the members that begin in it. Its first member is found by the members' first bytes and proved by
decoding; decoding goes on into the members behind the range, as a record may cross its end. A member is streamed, so a file
of one member of any size is read by its first range, in bounded memory. Paths are those that Arrow's file systems open.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

#: Bytes read at once.
CHUNK = 1 << 20
#: Bytes of a range, unless its reader is told otherwise.
RANGE_BYTES = 64 << 20
#: Decoded bytes that prove a member's beginning.
PROOF = 1 << 16
GZIP, ZSTD = b"\x1f\x8b\x08", b"\x28\xb5\x2f\xfd"


@dataclass(frozen=True)
class Range:
    """A byte range of a file, and what is known of the records that begin in it: `skip` decoded bytes before the first
    (None: not known), `base` records in the ranges before it, `n` in it."""

    file_idx: int
    path: str
    start: int
    end: int
    kind: str
    skip: int | None = None
    base: int = 0
    n: int = 0

    def at(self, **known) -> Range:
        return replace(self, **known)


def open_path(path: str):
    """A file system and the path within it; paths without a scheme are local."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        import os

        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def list_files(path: str) -> list[tuple[str, int]]:
    """Files behind a path with their sizes: itself, those of a folder in the order of names, or those a pattern matches.
    Names that begin with a dot or an underscore are left out. None found is an error."""
    import fnmatch

    from pyarrow import fs

    system, inner = open_path(path)
    prefix = "" if system.type_name == "local" else path[: path.index("://") + 3]
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(inner))
    else:
        folder, _, pattern = inner.rpartition("/")
        found = [x for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if fnmatch.fnmatch(x.base_name, pattern)]
        found = [y for x in found for y in (system.get_file_info(fs.FileSelector(x.path)) if x.type == fs.FileType.Directory else [x])]
    kept = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and (info.type == fs.FileType.File or x.base_name[0] not in "._"))
    if not kept:
        raise FileNotFoundError(path)
    return [(prefix + p, n) for p, n in kept]


def kind_of(path: str) -> str:
    """plain, gzip or zstd, by a file's first bytes."""
    system, inner = open_path(path)
    with system.open_input_file(inner) as f:
        head = f.read(4)
    return "gzip" if head[:3] == GZIP else "zstd" if head == ZSTD else "plain"


def ranges_of(files: list[tuple[int, str, int]], range_bytes: int = RANGE_BYTES) -> list[Range]:
    """Ranges of (file_idx, path, size), in order; an empty file has none."""
    out = []
    for i, path, size in files:
        kind = kind_of(path) if size else "plain"
        out += [Range(i, path, a, min(a + range_bytes, size), kind) for a in range(0, size, range_bytes)]
    return out


def _decoder(kind: str):
    if kind == "gzip":
        return zlib.decompressobj(31)
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj()


def _proved(f, kind: str, at: int) -> bool:
    """Whether a member begins at `at`: its first bytes decode, to its end if it is short."""
    f.seek(at)
    decoder, made = _decoder(kind), 0
    while made < PROOF and not decoder.eof:
        raw = f.read(CHUNK // 16)
        if not raw:
            return False
        try:
            made += len(decoder.decompress(raw))
        except Exception:  # each library has its own error
            return False
    return True


def first_member(f, kind: str, start: int, end: int) -> int | None:
    """Where the first member begins that begins in [start, end)."""
    if start == 0:
        return 0
    mark = GZIP if kind == "gzip" else ZSTD
    at = start
    while at < end:
        f.seek(at)
        raw = f.read(min(CHUNK, end - at) + len(mark) - 1)
        i = raw.find(mark)
        while i >= 0:
            if at + i < end and _proved(f, kind, at + i):
                return at + i
            i = raw.find(mark, i + 1)
        at += CHUNK
    return None


def decoded(r: Range) -> Iterator[tuple[bool, bytes]]:
    """(owned, bytes): the decoded bytes of a range in order, and of what follows it, for as long as they are asked for."""
    system, inner = open_path(r.path)
    with system.open_input_file(inner) as f:
        if r.kind == "plain":
            at = r.start
            f.seek(at)
            while True:
                raw = f.read(min(CHUNK, r.end - at) if at < r.end else CHUNK)
                if not raw:
                    return
                yield at < r.end, raw
                at += len(raw)
        at = first_member(f, r.kind, r.start, r.end)
        if at is None:
            return
        f.seek(at)
        pending = b""
        while True:
            owned, decoder, begin = at < r.end, _decoder(r.kind), at
            while not decoder.eof:
                pending = pending or f.read(CHUNK)
                if not pending:
                    if at == begin:
                        return
                    raise EOFError(f"{r.path} ends within a member")
                out = decoder.decompress(pending)
                at += len(pending)
                pending = b""
                if out:
                    yield owned, out
            pending = decoder.unused_data
            at -= len(pending)
            if r.kind == "gzip" and pending.strip(b"\0") == b"" and not f.read(1):
                return  # padding
            if r.kind == "gzip":
                f.seek(at + len(pending))


def before_is_line_end(r: Range) -> bool:
    """Whether a plain range begins at the beginning of a line."""
    if r.start == 0:
        return True
    system, inner = open_path(r.path)
    with system.open_input_file(inner) as f:
        f.seek(r.start - 1)
        return f.read(1) == b"\n"


def chained(ranges: list[Range], count) -> list[Range]:
    """Ranges with skip, base and n. `count` takes ranges and returns, for each, (skip, n, owned, over): the decoded bytes
    before the first record, the records, the bytes owned, and the bytes behind these that the last record takes. A range
    guesses where its first record begins; what the range before it took says so for certain, and where they differ the
    range is counted again from there. Records are numbered through the files of one file_idx order."""
    known: dict[int, tuple] = dict(enumerate(count(ranges)))
    while True:
        again, carry, base, out = {}, 0, 0, []
        for i, r in enumerate(ranges):
            if r.start == 0:
                carry = 0
            skip, n, owned, over = known[i]
            if n and skip != carry or not n and owned > carry:
                if skip != carry:
                    again[i] = carry
                    break
            out.append(r.at(skip=carry, base=base, n=n))
            base += n
            carry = over if n or over else max(0, carry - owned)
        if not again:
            return out
        ((i, carry),) = again.items()
        known[i] = count([ranges[i].at(skip=carry)])[0]
