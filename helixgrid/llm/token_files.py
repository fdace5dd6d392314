"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file holds documents in ascending order of their ids:

    magic "HGT1"; counts of documents, tokens, ranks, control bytes, data bytes (5 x u64)
    document ids (i64), null flags (u8) and token counts (u64) of the documents
    the id of every rank (u32), most frequent first
    control bytes: two bits a token, lowest first, its number of bytes less one
    data bytes: ranks, little-endian

All integers are little-endian. Files are named so that their names' order is the order of documents.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import shared_dir, small_batches, text_groups, written
from .vocab import default_path, encoder, load

MAGIC = b"HGT1"
#: A new file begins after so many tokens.
FILE_TOKENS = 4_000_000
#: Number of bytes of each of the four tokens of a control byte.
LENGTHS = (np.arange(256)[:, None] >> (2 * np.arange(4)) & 3).astype(np.uint8) + np.uint8(1)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned integers below 2 ** 32."""
    ranks = ranks.astype("<u4")
    size = np.ones(len(ranks), np.uint8)
    for bits in (8, 16, 24):
        size += ranks >= 1 << bits
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    spread = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), spread[np.arange(4) < size[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The integers again: a table gives the lengths behind each control byte, their running sum the places."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def to_file(doc_ids: list[int | None], ids: list[np.ndarray], rank_of: np.ndarray, id_of: np.ndarray) -> bytes:
    counts = np.array([len(x) for x in ids], "<u8")
    control, data = encode_ranks(rank_of[np.concatenate(ids)] if ids else np.zeros(0, np.uint32))
    head = struct.pack("<5Q", len(ids), int(counts.sum()), len(id_of), len(control), len(data))
    known = np.array([0 if x is None else x for x in doc_ids], "<i8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join([MAGIC, head, known.tobytes(), null.tobytes(), counts.tobytes(), id_of.astype("<u4").tobytes(), control, data])


def from_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of tokens, and all tokens one after the other."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, tokens, ranks, control, data = struct.unpack_from("<5Q", raw, 4)
    at = 44
    known = np.frombuffer(raw, "<i8", docs, at)
    null = np.frombuffer(raw, np.uint8, docs, at := at + 8 * docs)
    counts = np.frombuffer(raw, "<u8", docs, at := at + docs)
    id_of = np.frombuffer(raw, "<u4", ranks, at := at + 8 * docs)
    at += 4 * ranks
    ids = id_of[decode_ranks(raw[at : at + control], raw[at + control : at + control + data], tokens)]
    return [None if z else int(x) for x, z in zip(known, null, strict=True)], counts.astype(np.int64), ids


def _kind(path: str) -> str:
    """The integers that hold any id of the vocabulary."""
    return "<u4" if load(path).get_vocab_size(with_added_tokens=True) > 1 << 16 else "<u2"


def stage_ids(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int) -> DataFrame:
    """Ids of every text, encoded once: kind 0 rows hold a document's ids (16 bits each where the vocabulary allows it),
    a kind 1 row the frequencies that a task has seen. Written to the shared folder, apart by kind."""
    spark = docs.sparkSession
    small_batches(spark)
    kind, end = _kind(path), np.array([end_id], "<u4").tobytes()

    def run(batches):
        seen, place = np.zeros(0, np.int64), 0
        schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("place", pa.int64()), ("ids", pa.binary())])
        for part, texts in text_groups(batches):
            got = [np.frombuffer(x + end, "<u4") for x in encoder(path, True).encode(texts)]
            freq = np.bincount(np.concatenate(got))
            if len(freq) > len(seen):
                seen, freq = freq, seen
            seen[: len(freq)] += freq
            n = len(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), part.column(0), pa.array(np.arange(place, place + n)), pa.array([x.astype(kind).tobytes() for x in got], pa.binary())], schema=schema)
            place += n
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([seen.astype("<i8").tobytes()])], schema=schema)

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = read.mapInArrow(run, "kind int, id long, place long, ids binary")
    to = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    out.write.partitionBy("kind").option("compression", "zstd").parquet(to)
    return spark.read.schema("id long, place long, ids binary, kind int").parquet(to)


def frequencies(staged: DataFrame) -> list[tuple[int, int]]:
    """(id, count) over the whole corpus, most frequent first, ties to the smaller id; as many rows as ids occur."""

    def run(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                seen = np.frombuffer(raw, "<i8")
                for i in np.flatnonzero(seen).tolist():
                    total[i] = total.get(i, 0) + int(seen[i])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["id", "n"])

    found = staged.where("kind = 1").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return sorted(((r["id"], r["n"]) for r in found), key=lambda x: (-x[1], x[0]))


def write_token_files(docs: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes every text, appends the end id and writes token files to the folder `to`, in ascending order of id (nulls
    first, repeats in any fixed order). Returns the manifest: file, n_docs, n_tokens. Null and empty texts are their end
    id alone. A file is written under a temporary name and then renamed, so a repeated task leaves the same files."""
    path = path or default_path("byte_bpe_50k.json")
    staged = stage_ids(docs, id_col, text_col, path, end_id)
    found = frequencies(staged)
    total = sum(n for _, n in found)
    id_of = np.array([i for i, _ in found], dtype=np.uint32)
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    # Bounded by the vocabulary.
    tables = docs.sparkSession.sparkContext.broadcast((rank_of, id_of))
    kind = _kind(path)

    def run(batches):
        task = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(to)
        store.create_dir(folder, recursive=True)
        names, held_ids, held, n, k = [], [], [], 0, 0

        def flush():
            nonlocal held_ids, held, n, k
            name = f"part-{task.partitionId():06d}-{k:06d}.hgt"
            temp = f"{folder}/_{name}.{task.taskAttemptId()}"
            with store.open_output_stream(temp) as f:
                f.write(to_file(held_ids, held, *tables.value))
            store.move(temp, f"{folder}/{name}")
            names.append((name, len(held), n))
            held_ids, held, n, k = [], [], 0, k + 1

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(x, kind)
                if held and n + len(ids) > file_tokens:
                    flush()
                held_ids.append(i)
                held.append(ids)
                n += len(ids)
        if held:
            flush()
        if names:
            cols = list(zip(*names, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["file", "n_docs", "n_tokens"])

    parts = max(1, -(-total // file_tokens))
    ordered = staged.where("kind = 0").select("id", "ids", "place").repartitionByRange(parts, "id", "place").sortWithinPartitions("id", "place").select("id", "ids")
    return written(ordered.mapInArrow(run, "file string, n_docs long, n_tokens long"), "manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Documents of token files, read by Spark: id, start (tokens of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs, counts, ids = from_file(raw)
                ends = np.cumsum(counts)
                plain = ids.astype("<u4").tobytes()
                starts = ends - counts
                crc = [zlib.crc32(plain[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(docs)), pa.array(docs, pa.int64()), pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())], ["file", "id", "at", "n_tokens", "ids_crc32"])

    # The running sum is over the manifest, a row for each file, in the order of the files' numbers.
    before = F.sum("n_tokens").over(Window.orderBy(F.regexp_extract("file", r"(\d+)", 1).cast("long"), "file").rowsBetween(Window.unboundedPreceding, -1))
    base = manifest.select("file", F.coalesce(before, F.lit(0)).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.hgt").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, "file string, id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(base, "file").select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_file_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0, to: str | None = None) -> DataFrame:
    """Writes token files of all texts and reads them back: id, start, n_tokens (with the end id), ids_crc32, a row for
    each row. Nulls, empties and repeats as in write_token_files; other columns, whatever their names, are not read; an
    empty table gives an empty result."""
    spark = docs.sparkSession
    to = to or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_token_files(docs, to, id_col, text_col, path, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], f"{id_col} long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, to, manifest).withColumnRenamed("id", id_col)
