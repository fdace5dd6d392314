"""Files that tasks write and the driver commits, and text with a header in front."""

from __future__ import annotations

import contextlib
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .containers import open_path

#: Bytes of a block before compression, and the block that ends a file.
BLOCK = 0xFF00
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(raw: bytes) -> bytes:
    """Bytes as a BGZF block, which is a gzip member that tells its size."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = c.compress(raw) + c.flush()
    size = len(data) + 25
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + size.to_bytes(2, "little") + data + zlib.crc32(raw).to_bytes(4, "little") + len(raw).to_bytes(4, "little")


class Blocks:
    """Gathers bytes into blocks of a file."""

    def __init__(self, f):
        self.f, self.held = f, bytearray()

    def put(self, raw: bytes, whole: bool = False) -> None:
        """Adds bytes, which begin a block of their own if they are to stay `whole` and the one begun lacks room."""
        if whole and self.held and len(self.held) + len(raw) > BLOCK:
            self.flush()
        self.held += raw
        while len(self.held) > BLOCK:
            self.f.write(block(bytes(self.held[:BLOCK])))
            del self.held[:BLOCK]

    def flush(self) -> None:
        if self.held:
            self.f.write(block(bytes(self.held)))
            self.held.clear()

    def close(self) -> None:
        self.flush()
        self.f.write(END_BLOCK)


class Written(WriterCommitMessage):
    def __init__(self, part: int, path: str):
        self.part, self.path = part, path


class PartsWriter(DataSourceWriter):
    """A folder of files, one for each partition, in the order of the partitions. Tasks write under names of their own
    attempts; the driver's commit gives the attempts that count their final names, so that a task that ran twice leaves one
    file, and a job that failed none. `put` writes the rows of a partition into an open file."""

    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path.rstrip("/"), suffix, overwrite
        self.attempts = f"{self.path}/_attempts-{uuid.uuid4().hex}"

    def put(self, rows, f, part: int) -> None:
        raise NotImplementedError

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        return self._attempt(iterator, TaskContext.get().partitionId())

    def _attempt(self, rows, part: int) -> Written:
        path = f"{self.attempts}/{part}-{uuid.uuid4().hex}"
        system, inner = open_path(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(inner, compression=None) as f:
            self.put(rows, f, part)
        return Written(part, path)

    def commit(self, messages) -> None:
        from pyarrow import fs

        done = sorted((m for m in messages if m is not None), key=lambda m: m.part) or [self._attempt(iter(()), 0)]
        system, folder = open_path(self.path)
        old = [x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.base_name.startswith("part-")]
        first = 0
        if old and not self.overwrite:
            first = 1 + max(int(p.rpartition("/")[2][5:10]) for p in old)
        else:
            for p in old:
                system.delete_file(p)
        for m in done:
            system.move(open_path(m.path)[1], f"{folder}/part-{first + m.part:05d}{self.suffix}")
        system.delete_dir(open_path(self.attempts)[1])

    def abort(self, messages) -> None:
        system, inner = open_path(self.attempts)
        with contextlib.suppress(FileNotFoundError):
            system.delete_dir(inner)


class _TextWriter(PartsWriter):
    def __init__(self, path: str, header: str, suffix: str, compression: str, overwrite: bool):
        super().__init__(path, suffix, overwrite)
        self.header, self.compression = header, compression

    def put(self, rows, f, part: int) -> None:
        out = Blocks(f) if self.compression == "gzip" else None
        write = out.put if out else f.write
        if part == 0 and self.header:
            write(self.header.encode() + b"\n")
        for row in rows:
            write(row[0].encode() + b"\n")
        if out:
            out.close()


class TextSource(DataSource):
    """Lines with a header in front of the first file."""

    @classmethod
    def name(cls) -> str:
        return "helixgrid_text"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        o = self.options
        return _TextWriter(o["path"], o.get("header", ""), o["suffix"], o["compression"], overwrite)


def write_lines(lines: DataFrame, path: str, header: str = "", suffix: str = ".txt", compression: str = "gzip") -> None:
    """A folder of files of lines (the one column of `lines`), which one after the other are one file: the header stands in
    front of the first, and partitions keep their order. Compression: none, or gzip in BGZF blocks. No rows give the header."""
    if compression not in ("none", "gzip"):
        raise ValueError(f"compression is none or gzip, not {compression}")
    spark = lines.sparkSession
    spark.dataSource.register(TextSource)
    suffix += ".gz" if compression == "gzip" else ""
    lines.write.format("helixgrid_text").mode("append").options(path=path, header=header, suffix=suffix, compression=compression).save()
