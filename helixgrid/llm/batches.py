"""Helpers that several operators share: Arrow batches, shared storage and chunk caches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Characters of text handled together, so that a task's memory does not follow the length of texts.
GROUP_CHARS = 1_000_000
#: Chunks remembered by a Python worker before it starts over.
CACHE_CHUNKS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session makes and sets a
    temporary folder; a cluster fails."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark removes the shuffle files of a query at its end where this is set (since 4.1; older versions do not read it).
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends here, for lost executors too. Shuffle files
    of the write go with it; else they stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the rows of an Arrow batch, as texts may be very long. Lowers the setting, never raises it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


_tool: dict = {}


def give_back() -> None:
    """Returns memory that a Python worker has freed to the system, which else stays with the worker for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc only
        ctypes.CDLL(None).malloc_trim(0)


def tool(key: tuple, make: Callable[[], object]):
    """What an operator keeps in a Python worker process between batches. A worker holds one at a time, as Spark reuses
    workers for later stages, whose tools would else add up."""
    if key not in _tool:
        _tool.clear()
        give_back()
        _tool[key] = make()
    return _tool[key]


def grouped(items: Iterable, size: Callable[[object], int], most: int = GROUP_CHARS) -> Iterator[list]:
    """Consecutive items in lists of about `most` units at most; a larger item stands alone."""
    group: list = []
    held = 0
    for x in items:
        n = size(x)
        if group and held + n > most:
            yield group
            group, held = [], 0
        group.append(x)
        held += n
    if group:
        yield group


def text_groups(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of batches with their texts (None kept), of about GROUP_CHARS characters each."""
    for batch in batches:
        start = 0
        texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
        for group in grouped(texts, lambda x: len(x) if x is not None else 0):
            yield batch.slice(start, len(group)), group
            start += len(group)


class ChunkCache(dict):
    """Results by chunk of text. `fill` gets the list of unknown chunks and returns their results in order.

    The size is bounded: beyond CACHE_CHUNKS entries it starts over, which costs time and changes no result.
    """

    def __init__(self, fill: Callable[[list], list], most: int = CACHE_CHUNKS):
        super().__init__()
        self.fill, self.most = fill, most

    def learn(self, lists: Iterable[list]) -> None:
        unknown = list({c for chunks in lists for c in chunks if c not in self})
        if not unknown:
            return
        if len(self) + len(unknown) > self.most and len(self):
            keep = {c for chunks in lists for c in chunks if c in self}
            held = {c: self[c] for c in keep}
            self.clear()
            self.update(held)
        self.update(zip(unknown, self.fill(unknown), strict=True))


class RowCache(dict):
    """Rows of a matrix by word. `fill` gets the list of unknown words and returns their rows; bounded as ChunkCache."""

    def __init__(self, fill: Callable[[list], np.ndarray], columns: int, most: int = CACHE_CHUNKS):
        super().__init__()
        self.fill, self.most = fill, most
        self.rows = np.zeros((1024, columns))

    def learn(self, lists: Iterable[list]) -> None:
        unknown = list({c for words in lists for c in words if c not in self})
        if not unknown:
            return
        if len(self) + len(unknown) > self.most and len(self):
            self.clear()
            unknown = list({c for words in lists for c in words})
        found, n = self.fill(unknown), len(self)
        if n + len(found) > len(self.rows):
            more = np.zeros((max(n + len(found), 2 * len(self.rows)) - n, self.rows.shape[1]))
            self.rows = np.concatenate([self.rows[:n], more])
        self.rows[n : n + len(found)] = found
        self.update(zip(unknown, range(n, n + len(found)), strict=True))

    def total(self, words: list) -> np.ndarray:
        """Sum of the rows of words, all of them learned."""
        return self.rows[np.fromiter(map(self.__getitem__, words), np.int64, len(words))].sum(axis=0)
