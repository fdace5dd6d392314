"""BAM files as DataFrames, and DataFrames as BAM files: a Python data source over ranges of BGZF blocks.

A range owns the records that begin in the blocks that begin in it. Its first record is the first place from which a chain of
plausible records follows; the range before it says for certain where that is (see containers.chained), so that a wrong guess
costs another count and never a record. Records become columns by numpy over whole batches.
"""

from __future__ import annotations

import base64
import functools
import json
import pickle
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition

from ..functions.seq import strip_mate_suffix
from .containers import RANGE_BYTES, Range, chained, decoded, list_files, ranges_of
from .parts import Blocks, PartsWriter

# Fixed values of the format.
MAGIC = b"BAM\1"
BASES = "=ACMGRSVTWYHKDBN"
CIGAR_OPS = "MIDNSHP=X"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
#: The fixed part of a record, its size included.
FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")])
#: Consecutive plausible records that a guess asks for.
CHAIN = 6
TAGS = {"MD": "md", "CB": "barcode", "CR": "raw_barcode", "UB": "umi_corrected", "UR": "umi_raw"}
COUNTED = "place int, skip long, n long, owned long, over long"
RECORDS = "rec_idx long, name string, flags int, chrom string, pos long, mapq int, cigar string, seq string, qual string, mate_chrom string, mate_pos long, template int, md string, barcode string, raw_barcode string, umi_corrected string, umi_raw string"


def read_header(path: str) -> tuple[str, list[tuple[str, int]], int]:
    """Text, reference sequences (name, length) and decoded size of a file's header."""
    held = b""
    stream = decoded(Range(0, path, 0, 1, "gzip"))

    def upto(n: int) -> None:
        nonlocal held
        while len(held) < n:
            got = next(stream, None)
            if got is None:
                raise EOFError(f"{path} ends within its header")
            held += got[1]

    upto(12)
    if held[:4] != MAGIC:
        raise ValueError(f"{path} is no BAM file")
    (size,) = struct.unpack_from("<i", held, 4)
    upto(12 + size)
    text, at = held[8 : 8 + size].rstrip(b"\0").decode(), 8 + size
    (n,) = struct.unpack_from("<i", held, at)
    at, refs = at + 4, []
    for _ in range(n):
        upto(at + 4)
        (size,) = struct.unpack_from("<i", held, at)
        upto(at + 8 + size)
        refs.append((held[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", held, at + 4 + size)[0]))
        at += 8 + size
    return text, refs, at


class Records:
    """The records that begin in a range: bytes and the places of records in them; skip, n, owned, over once they are read."""

    def __init__(self, r: Range, header: int, n_refs: int):
        self.range, self.header, self.n_refs = r, header, n_refs
        self.skip, self.n, self.owned, self.over = r.skip, 0, 0, 0

    def batches(self) -> Iterator[tuple[bytes, list[int]]]:
        chunks, held, at, limit, ended = decoded(self.range), b"", 0, None, False
        first = self.range.start == 0
        drop, started = (self.header, True) if first else (self.skip or 0, self.skip is not None)
        self.skip = 0 if first else self.skip
        while not ended and (limit is None or at < limit):
            owned, raw = next(chunks, (None, b""))
            ended = owned is None
            self.owned += len(raw) if owned else 0
            limit = self.owned if not owned and limit is None else limit
            held += raw
            if not started:
                found = self._first(held, limit, ended)
                if found is None:
                    if ended or (limit is not None and len(held) > limit + (1 << 20)):
                        return
                    continue
                self.skip, drop, started = found, found, True
            cut = min(drop, len(held))
            held, at, drop = held[cut:], at + cut, drop - cut
            if drop:
                continue
            places, o, n = [], 0, len(held)
            while o + 4 <= n and (limit is None or at + o < limit):
                end = o + 4 + int.from_bytes(held[o : o + 4], "little", signed=True)
                if end < o + 36:
                    raise ValueError(f"{self.range.path} has a broken record")
                if end > n:
                    break
                places.append(o)
                o = end
            if places:
                self.n += len(places)
                yield held, places
            held, at = held[o:], at + o
            if ended and held and at < (self.owned if limit is None else limit):
                raise EOFError(f"{self.range.path} ends within a record")
        self.over = max(0, at + drop - self.owned)

    def _first(self, held: bytes, limit: int | None, ended: bool) -> int | None:
        most = len(held) if limit is None else min(limit, len(held))
        for o in range(most):
            at, chain = o, 0
            while chain < CHAIN and (size := self._plausible(held, at)):
                at, chain = at + size, chain + 1
            if chain == CHAIN or (chain and ended and at == len(held)):
                return o
            if at + 36 > len(held) and chain and not ended:
                return None  # more bytes decide
        return None

    def _plausible(self, held: bytes, o: int) -> int:
        """Size of what may be a record at a place, 0 if none can be."""
        if o + 36 > len(held):
            return 0
        size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", held, o)
        if not (-1 <= ref < self.n_refs and -1 <= next_ref < self.n_refs and pos >= -1 and next_pos >= -1 and l_name and l_seq >= 0):
            return 0
        if size < 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq:
            return 0
        name = held[o + 36 : o + 36 + l_name]
        if l_name < 2 or len(name) < l_name or name[-1] or any(not 33 <= c <= 126 for c in name[:-1]):
            return 0
        return size + 4


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """Stretches of bytes as strings."""
    ends = np.cumsum(sizes)
    flat = data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]
    out = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], ends]).astype("<i4")), pa.py_buffer(flat.tobytes()))
    if missing is not None and missing.any():
        out = pa.compute.if_else(pa.array(missing), pa.scalar(None, pa.string()), out)
    return out


def _tags(raw: bytes, at: int, end: int) -> dict[str, object]:
    """Wanted text tags of a record, and its CIGAR operations if these stand in a tag."""
    found: dict[str, object] = {}
    while at + 3 <= end:
        tag, kind, at = raw[at : at + 2].decode("latin-1"), chr(raw[at + 2]), at + 3
        if kind in "ZH":
            stop = raw.index(b"\0", at, end)
            if tag in TAGS:
                found[tag] = raw[at:stop].decode()
            at = stop + 1
        elif kind == "B":
            size, n = TAG_SIZES[chr(raw[at])], int.from_bytes(raw[at + 1 : at + 5], "little")
            if tag == "CG":
                found["CG"] = raw[at + 5 : at + 5 + size * n]
            at += 5 + size * n
        else:
            if tag in TAGS and kind == "A":
                found[tag] = chr(raw[at])
            at += TAG_SIZES[kind]
    return found


def _cigar(raw: bytes) -> str | None:
    return "".join(f"{x >> 4}{CIGAR_OPS[x & 15]}" for x in np.frombuffer(raw, "<u4").tolist()) or None


_PAIRS = np.array([[ord(BASES[b >> 4]), ord(BASES[b & 15])] for b in range(256)], np.uint8)


def decode(raw: bytes, places: list[int], first: int, refs: pa.Array) -> pa.RecordBatch:
    """Columns of the records at `places`."""
    data, at = np.frombuffer(raw, np.uint8), np.array(places, dtype=np.int64)
    x = np.ascontiguousarray(data[at[:, None] + np.arange(36)]).view(FIXED)[:, 0]
    l_name, n_cigar, l_seq = (x[k].astype(np.int64) for k in ("l_name", "n_cigar", "l_seq"))
    cigar_at = at + 36 + l_name
    seq_at = cigar_at + 4 * n_cigar
    packed = (l_seq + 1) // 2
    qual_at = seq_at + packed
    tags_at, end = (qual_at + l_seq).tolist(), (at + 4 + x["size"]).tolist()
    tags = [_tags(raw, a, b) for a, b in zip(tags_at, end, strict=True)]
    known: dict[bytes, str | None] = {}
    cigars = []
    for a, b, t in zip(cigar_at.tolist(), seq_at.tolist(), tags, strict=True):
        ops = t.get("CG", raw[a:b])
        if ops not in known:
            known[ops] = _cigar(ops)
        cigars.append(known[ops])
    byte_ends = np.cumsum(packed)
    letters = _PAIRS[data[np.arange(int(byte_ends[-1])) + np.repeat(seq_at - (byte_ends - packed), packed)]].reshape(-1)
    seq = _strings(letters, 2 * (byte_ends - packed), l_seq, l_seq == 0)
    no_qual = (l_seq == 0) | (data[np.minimum(qual_at, len(data) - 1)] == 255)
    qual = _strings((data + np.uint8(33)) & np.uint8(127), qual_at, np.where(no_qual, 0, l_seq), no_qual)

    def name_of(ids: np.ndarray) -> pa.Array:
        return refs.take(pa.array(ids, mask=ids < 0))

    name = _strings(data, at + 36, l_name - 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(first, first + len(at))),
            pa.compute.if_else(pa.compute.equal(name, "*"), pa.scalar(None, pa.string()), name),
            pa.array(x["flag"].astype(np.int32)),
            name_of(x["ref"]),
            pa.array(x["pos"].astype(np.int64) + 1),
            pa.array(x["mapq"].astype(np.int32), mask=x["mapq"] == 255),
            pa.array(cigars, pa.string()),
            seq,
            qual,
            name_of(x["next_ref"]),
            pa.array(x["next_pos"].astype(np.int64) + 1),
            pa.array(x["tlen"]),
            *(pa.array([t.get(k) for t in tags], pa.string()) for k in TAGS),
        ],
        [c.split()[0] for c in RECORDS.split(", ")],
    )


class Work(InputPartition):
    """A range to count or to read, with its file's header size and sequences."""

    def __init__(self, place: int, range: Range, header: int, refs: list[str]):
        super().__init__(place)
        self.place, self.range, self.header, self.refs = place, range, header, refs


class _Reader(DataSourceReader):
    def __init__(self, what: str, work: list[Work]):
        self.what, self.work = what, work

    def partitions(self):
        return self.work

    def read(self, partition):
        records = Records(partition.range, partition.header, len(partition.refs))
        if self.what == "count":
            yield (partition.place, *_counted(records, partition.range))
            return
        refs, at = pa.array(partition.refs, pa.string()), partition.range.base
        for raw, places in records.batches():
            yield decode(raw, places, at, refs)
            at += len(places)


def _counted(records: Records, r: Range) -> tuple:
    try:
        for _ in records.batches():
            pass
        sound = True
    except (EOFError, ValueError):
        if r.start == 0 or r.skip is not None:
            raise
        sound = False  # a wrong guess; or a right one, and the scan fails here too
    owned = records.owned
    if not records.n or not sound:
        owned = sum(len(raw) for mine, raw in _while_owned(r))
    return records.skip, records.n, owned, records.over


def _while_owned(r: Range):
    for mine, raw in decoded(r):
        if not mine:
            return
        yield mine, raw


class BamSource(DataSource):
    """Reads work that the functions of this module hand over, pickled in an option; writes alignments into a folder."""

    @classmethod
    def name(cls) -> str:
        return "helixgrid_bam"

    def schema(self) -> str:
        return COUNTED if self.options["what"] == "count" else RECORDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["what"], pickle.loads(base64.b64decode(self.options["work"])))

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Writer(self.options["path"], json.loads(self.options["references"]), self.options.get("text", ""), overwrite)


def _load(spark: SparkSession, what: str, work: list[Work]) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("helixgrid_bam").options(what=what, work=base64.b64encode(pickle.dumps(work)).decode()).load()


def read_bam(spark: SparkSession, paths: list[str] | str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Alignments of BAM files, with the columns of `read_sam`, and rec_idx (from 0 over all files, in their order), mate_pos
    and template. A folder stands for its files. Tasks read ranges of about `range_bytes`; a first pass counts the records,
    the scan is one more and has no shuffle. What is unknown is null; positions count from 1. Files may differ in their
    sequences. A file of no alignments gives none; one that breaks off fails. A row for each range comes to the driver."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = [(i, f, size) for i, (f, size) in enumerate(x for p in paths for x in list_files(p))]
    headers = {f: read_header(f) for _, f, _ in files}
    work = lambda some: [Work(k, r, headers[r.path][2], [n for n, _ in headers[r.path][1]]) for k, r in enumerate(some)]

    def count(some: list[Range]) -> list[tuple]:
        rows = _load(spark, "count", work(some)).collect()
        return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.place)]

    ranges = [r for r in chained(ranges_of(files, range_bytes), count) if r.n]
    rows = _load(spark, "records", work(ranges)) if ranges else spark.createDataFrame([], RECORDS)
    last = F.col("flags").bitwiseAND(128) != 0
    return rows.withColumns({"name": strip_mate_suffix("name"), "umi": F.coalesce("umi_corrected", "umi_raw"), "mate": F.when(last, 2).otherwise(1)}).drop("umi_corrected", "umi_raw")


def bam_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, length of the sequences in the header of a BAM file (the first of a folder's)."""
    refs = read_header(list_files(path)[0][0])[1]
    return spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(refs)], "ord int, name string, length long")


def _bin(start: int, end: int) -> int:
    """The smallest bin of the format's index that holds [start, end)."""
    last = end - 1
    for level, shift in enumerate((14, 17, 20, 23, 26)):
        if start >> shift == last >> shift:
            return ((1 << 3 * (5 - level)) - 1) // 7 + (start >> shift)
    return 0


_CODES = {c: i for i, c in enumerate(BASES)} | {c.lower(): i for i, c in enumerate(BASES)}
_OPS = {c: i for i, c in enumerate(CIGAR_OPS)}


class _Digits(dict):
    """Hex digits of bases, by their code points; other letters are N."""

    def __missing__(self, _):
        return "f"


_HEX = _Digits({ord(c): f"{i:x}" for c, i in _CODES.items()})
_PHRED = bytes(max(c - 33, 0) for c in range(256))


@functools.lru_cache(1 << 14)
def _packed_cigar(cigar: str) -> tuple[bytes, int]:
    """Operations of a CIGAR string as a record holds them, and the bases of the reference that they span."""
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    return struct.pack(f"<{len(ops)}I", *(n << 4 | _OPS[op] for n, op in ops)), sum(n for n, op in ops if op in "MDN=X")


def encode(row, ids: dict[str, int]) -> bytes:
    """A row as a record; columns that it lacks are unknown."""
    x = row.asDict()
    get = x.get
    name = (get("name") or "*").encode() + b"\0"
    if len(name) > 255:
        raise ValueError("a name is longer than 254 bytes")
    text = get("cigar") or ""
    # Short ones recur; long ones would fill the memory of the cache.
    cigar, span = _packed_cigar(text) if len(text) <= 64 else _packed_cigar.__wrapped__(text)
    seq, qual = get("seq") or "", get("qual")
    pos = (get("pos") or 0) - 1
    packed = bytes.fromhex(seq.translate(_HEX) + "0" * (len(seq) % 2))
    if qual is not None and len(qual) != len(seq):
        raise ValueError(f"qualities and bases of {get('name')} differ in length")
    tags = b"".join(k.encode() + b"Z" + x[c].encode() + b"\0" for k, c in (("MD", "md"), ("CR", "raw_barcode"), ("CB", "barcode"), ("UR", "umi")) if get(c) is not None)
    if len(cigar) > 4 * 0xFFFF:
        tags += b"CGBI" + struct.pack("<I", len(cigar) // 4) + cigar
        cigar = struct.pack("<2I", len(seq) << 4 | _OPS["S"], span << 4 | _OPS["N"])
    raw = None if qual is None else qual.encode("latin-1")
    if raw and min(raw) < 33:
        raise ValueError(f"a quality of {get('name')} is below 0")
    quality = b"\xff" * len(seq) if raw is None else raw.translate(_PHRED)
    ref = -1 if get("chrom") is None else ids[x["chrom"]]
    next_ref = -1 if get("mate_chrom") is None else ids[x["mate_chrom"]]
    mapq = 255 if get("mapq") is None else x["mapq"]
    where = _bin(max(pos, 0), max(pos, 0) + max(span, 1)) if pos >= 0 else 4680
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), mapq, where, len(cigar) // 4, get("flags") or 0, len(seq), next_ref, (get("mate_pos") or 0) - 1, get("template") or 0)
    body += name + cigar + packed + quality + tags
    return struct.pack("<i", len(body)) + body


def header_bytes(references: list[tuple[str, int]], text: str = "") -> bytes:
    lines = text or "@HD\tVN:1.6\tSO:unsorted\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in references)
    out = MAGIC + struct.pack("<i", len(lines.encode())) + lines.encode() + struct.pack("<i", len(references))
    for n, size in references:
        out += struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    return out


class _Writer(PartsWriter):
    def __init__(self, path: str, references: list, text: str, overwrite: bool):
        super().__init__(path, ".bam", overwrite)
        self.references, self.text = references, text

    def put(self, rows, f, part: int) -> None:
        out = Blocks(f)
        out.put(header_bytes(self.references, self.text))
        out.flush()
        ids = {n: i for i, (n, _) in enumerate(self.references)}
        for row in rows:
            out.put(encode(row, ids), whole=True)
        out.close()


def write_bam(alignments: DataFrame, path: str, references: DataFrame | list[tuple[str, int]], text: str = "", overwrite: bool = False) -> None:
    """A folder of BAM files, one for each partition and whole in itself, in the order of the partitions. `alignments` has
    columns of `read_bam`, of which any but the name may be missing; `references` (name, length; a table also with ord) are
    the sequences of the header, a list as long as an assembly has sequences. A sequence that is not among them, and
    qualities of another length than the bases, fail. With `text` the header's text is that."""
    spark = alignments.sparkSession
    if not isinstance(references, list):
        references = [(r["name"], r["length"]) for r in references.orderBy("ord").select("name", "length").collect()]
    spark.dataSource.register(BamSource)
    alignments.write.format("helixgrid_bam").mode("overwrite" if overwrite else "append").options(path=path, references=json.dumps(references), text=text).save()
