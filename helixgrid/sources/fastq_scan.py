"""FASTQ records by byte ranges: a Python data source whose partitions find their first record themselves.

A first pass counts the records of every range; a running sum numbers them, and the scan itself is one pass without a
shuffle. In lockstep, a partition reads one stretch of record numbers of all files, each from the range that holds its first.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .containers import RANGE_BYTES, Range, before_is_line_end, chained, decoded, list_files, ranges_of

#: Records of an Arrow batch.
BATCH = 10_000
COUNTED = "place int, skip long, n long, owned long, over long"
RECORDS = "file_idx int, rec_idx long, head string, seq string, plus string, qual string, size int"


def _is_record(lines: list[bytes]) -> bool:
    """Whether four lines are a record: a line of qualities may begin as a header does, but then the third line is a
    sequence, which never begins with a plus."""
    return lines[0].startswith(b"@") and lines[2].startswith(b"+") and len(lines[1].rstrip(b"\r")) == len(lines[3].rstrip(b"\r"))


class Records:
    """The records that begin in a range, as lists of four lines; `skip`, `n`, `owned` and `over` once they are read."""

    def __init__(self, r: Range):
        self.range, self.skip, self.n, self.owned, self.over = r, r.skip, 0, 0, 0

    def lists(self) -> Iterator[list[bytes]]:
        """Lists of lines, four for each record, in order."""
        chunks, held, at, limit = decoded(self.range), b"", 0, None
        drop, started, ended = self.skip or 0, self.skip is not None, False
        at_line = started or self.range.kind != "plain" or before_is_line_end(self.range)
        while not ended and (limit is None or at < limit):
            owned, raw = next(chunks, (None, b""))
            ended = owned is None
            self.owned += len(raw) if owned else 0
            limit = self.owned if not owned and limit is None else limit
            held += raw
            if not started:
                found, over = self._first(held, at_line, limit, ended)
                if found is None:
                    if over:
                        return
                    continue
                self.skip, drop, started = found, found, True
            cut = min(drop, len(held))
            held, at, drop = held[cut:], at + cut, drop - cut
            if drop:
                continue
            lines, held = _lines(held, ended)
            kept = len(lines)
            if limit is not None:
                kept, size = 0, at
                while kept < len(lines) and size < limit:
                    size += sum(map(len, lines[kept : kept + 4])) + 4
                    kept += 4
            at += sum(map(len, lines[:kept])) + kept
            lines = lines[:kept]
            if b"" in lines[::4]:  # blank lines at the end of a file, four and more
                lines = [x for i in range(0, kept, 4) if lines[i] for x in lines[i : i + 4]]
            self.n += len(lines) // 4
            if lines:
                yield lines
        self.over = max(0, at + drop - self.owned)

    def _first(self, held: bytes, at_line: bool, limit: int | None, ended: bool) -> tuple[int | None, bool]:
        """Where the first record begins, and whether it is certain that none does."""
        if self.range.start == 0:
            return 0, False
        at = 0 if at_line else held.find(b"\n") + 1
        lines = held[at:].split(b"\n") if at or at_line else []
        if lines and (not ended or lines[-1] == b""):
            lines.pop()
        for i in range(len(lines) - 3):
            if limit is not None and at >= limit:
                return None, True
            if _is_record(lines[i : i + 4]):
                return at, False
            at += len(lines[i]) + 1
        return None, ended


def _lines(held: bytes, ended: bool) -> tuple[list[bytes], bytes]:
    """The lines of whole records, and the bytes behind them. At the end of a file, blank lines go and what is left is a
    record that breaks off."""
    lines = held.split(b"\n")
    if not ended:
        whole = (len(lines) - 1) // 4 * 4
        return lines[:whole], b"\n".join(lines[whole:])
    while lines and not lines[-1].strip() and (len(lines) % 4 or not lines[-4].strip()):
        lines.pop()
    return lines + [b""] * (-len(lines) % 4), b""


def count_range(r: Range) -> tuple[int | None, int, int, int]:
    """skip, n, owned, over of a range; see chained."""
    records = Records(r)
    for _ in records.lists():
        pass
    owned = records.owned
    if not records.n:  # all that it owns must be known, as a record before it may take only a part
        owned = r.end - r.start if r.kind == "plain" else sum(len(raw) for _, raw in itertools.takewhile(lambda x: x[0], decoded(r)))
    return records.skip, records.n, owned, records.over


class Work(InputPartition):
    """A range to count or to read."""

    def __init__(self, place: int, range: Range):
        super().__init__(place)
        self.place, self.range = place, range


class Stretch(InputPartition):
    """Records [first, last) of several files: for each read id the ranges that hold them."""

    def __init__(self, first: int, last: int, ranges: dict):
        super().__init__(first)
        self.first, self.last, self.ranges = first, last, ranges


def _text(items: list[bytes]) -> pa.Array:
    return pa.array([x[:-1] if x.endswith(b"\r") else x for x in items], pa.binary()).cast(pa.string())


def _batch(file_idx: int, first: int, lines: list[bytes], schema: pa.Schema) -> pa.RecordBatch:
    n = len(lines) // 4
    parts = [lines[k::4] for k in range(4)]
    size = [len(a) + len(b) + len(c) + len(d) + 4 for a, b, c, d in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([file_idx] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), *map(_text, parts), pa.array(size, pa.int32())], schema=schema)


_ARROW = pa.schema([("file_idx", pa.int32()), ("rec_idx", pa.int64()), ("head", pa.string()), ("seq", pa.string()), ("plus", pa.string()), ("qual", pa.string()), ("size", pa.int32())])


class _Reader(DataSourceReader):
    def __init__(self, source):
        self.what, self.work = source.what, source.work

    def partitions(self):
        return self.work

    def read(self, partition):
        if self.what == "count":
            yield (partition.place, *count_range(partition.range))
        elif self.what == "records":
            r = partition.range
            at = r.base
            for lines in Records(r).lists():
                for a in range(0, len(lines), 4 * BATCH):
                    part = lines[a : a + 4 * BATCH]
                    yield _batch(r.file_idx, at, part, _ARROW)
                    at += len(part) // 4
        else:
            yield from _together(partition)


def _stretch_lines(ranges: list[Range], first: int, last: int) -> Iterator[tuple[int, list[bytes]]]:
    """(file_idx, lines) of records first to last of one read's files."""
    for r in ranges:
        at = r.base
        for lines in Records(r).lists():
            n = len(lines) // 4
            a, b = max(first, at), min(last, at + n)
            if a < b:
                yield r.file_idx, lines[4 * (a - at) : 4 * (b - at)]
            at += n
            if at >= last:
                break


def _together(s: Stretch) -> Iterator[pa.RecordBatch]:
    streams = {k: _stretch_lines(ranges, s.first, s.last) for k, ranges in s.ranges.items()}
    held: dict[str, list[bytes]] = {k: [] for k in streams}
    struct = pa.struct([("head", pa.string()), ("seq", pa.string()), ("plus", pa.string()), ("qual", pa.string()), ("size", pa.int32())])
    at = s.first
    while at < s.last:
        for k, stream in streams.items():
            if not held[k]:
                held[k] = next(stream)[1]
        n = min(BATCH, *(len(x) // 4 for x in held.values())) if len(held) > 1 else min(BATCH, len(next(iter(held.values()))) // 4)
        columns = []
        for k, lines in held.items():
            b = _batch(0, 0, lines[: 4 * n], _ARROW)
            columns.append(pa.StructArray.from_arrays(b.columns[2:], fields=list(struct)))
            held[k] = lines[4 * n :]
        yield pa.RecordBatch.from_arrays([pa.array(range(at, at + n), pa.int64()), *columns], ["rec_idx", *held])
        at += n


class FastqSource(DataSource):
    """Work is handed over by the functions of this module, pickled in an option."""

    @classmethod
    def name(cls) -> str:
        return "helixgrid_fastq"

    def __init__(self, options):
        super().__init__(options)
        import base64
        import pickle

        self.what = options["what"]
        self.work = pickle.loads(base64.b64decode(options["work"]))

    def schema(self) -> str:
        if self.what == "count":
            return COUNTED
        if self.what == "records":
            return RECORDS
        return "rec_idx long, " + ", ".join(f"`{k}` struct<head:string,seq:string,plus:string,qual:string,size:int>" for k in self.work[0].ranges)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)


def _load(spark: SparkSession, what: str, work: list) -> DataFrame:
    import base64
    import pickle

    spark.dataSource.register(FastqSource)
    return spark.read.format("helixgrid_fastq").options(what=what, work=base64.b64encode(pickle.dumps(work)).decode()).load()


def index(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> list[Range]:
    """Ranges of the files behind paths, with the records of each counted by a job of one task a range. A row for each range
    comes to the driver: one for 64 MB of a file."""
    files = [(i, f, size) for i, p in enumerate(paths) for f, size in list_files(p)]
    ranges = ranges_of(files, range_bytes)

    def count(some: list[Range]) -> list[tuple]:
        if not some:
            return []
        rows = _load(spark, "count", [Work(k, r) for k, r in enumerate(some)]).collect()
        return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.place)]

    return chained(ranges, count)


def scan(spark: SparkSession, ranges: list[Range]) -> DataFrame:
    """file_idx, rec_idx and the four lines of every record, in one pass."""
    return _load(spark, "records", [Work(k, r) for k, r in enumerate(r for r in ranges if r.n)])


def scan_together(spark: SparkSession, ranges: dict[str, list[Range]]) -> DataFrame:
    """rec_idx and, for each read id, the four lines of its record of that number. Partitions are the ranges of the first
    read; of the others each reads the ranges that hold its records. Files of unequal numbers of records fail."""
    totals = {k: sum(r.n for r in x) for k, x in ranges.items()}
    if len(set(totals.values())) > 1:
        raise ValueError(f"reads do not belong together, as their numbers differ: {totals}")
    widest = max(ranges, key=lambda k: sum(r.end - r.start for r in ranges[k]))
    work = []
    for lead in ranges[widest]:
        if lead.n:
            first, last = lead.base, lead.base + lead.n
            work.append(Stretch(first, last, {k: [r for r in x if r.n and r.base < last and r.base + r.n > first] for k, x in ranges.items()}))
    return _load(spark, "together", work)
