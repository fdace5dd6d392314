"""Best-fit packing of documents into sequences under several capacities at once."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small_batches, text_groups, written
from .vocab import default_path, encoder

#: Pieces packed together by one task.
GROUP_PIECES = 20_000
#: Pieces and attention cost of a sequence that are preferred, in multiples of the mean of the fewest sequences.
PREFERRED = 2.0
#: Weights of tokens, documents and attention cost in the choice of a bin.
WEIGHTS = (1.0, 1e-3, 1e-3)


def vector_best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = WEIGHTS, by: str = "norm", preferred: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, pieces in decreasing length.

    A piece asks for (length, 1, length ** 2) of (tokens, documents, attention cost). Among the open bins with room for
    it under all three, those that stay within the `preferred` documents and cost come first, if there are any. Of these
    by="norm" takes the one with the smallest weighted norm of what would be left, by="dot" the one with the largest
    weighted dot product of what is left and what is asked, documents and cost as shares of the preferred ones (of the
    capacities, if none are preferred); ties go to the older bin.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    soft = capacity[1:] if preferred is None else preferred
    # Of open bins: tokens, documents and cost as shares of the capacities, documents and cost as shares of the preferred.
    top, w = np.array([*capacity, *soft], dtype=float), np.array(weights, dtype=float)
    seen = np.array([0, 3, 4])
    room = np.zeros((1024, 5))
    number = np.zeros(1024, np.int64)
    used: list[int] = []
    open_n = 0
    smallest = float(lengths.min()) / top[0] if n else 0.0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        need = np.array([size, 1.0, float(size) ** 2, 1.0, float(size) ** 2]) / top
        fit = np.flatnonzero(room[:open_n, 0] >= need[0] - 1e-12) if open_n else ()
        if len(fit):
            left = room[fit] - need
            on = left[:, :3].min(axis=1) >= -1e-12
            easy = on & (left[:, 3:].min(axis=1) >= -1e-12)
            on = easy if easy.any() else on
            fit, left = fit[on], left[on]
        if len(fit):
            worth = (w * left[:, seen] ** 2).sum(axis=1) if by == "norm" else -(w * room[fit][:, seen] * need[seen]).sum(axis=1)
            j = int(fit[np.argmin(worth)])
        else:
            if open_n == len(room):
                room, number = np.vstack([room, np.zeros_like(room)]), np.concatenate([number, np.zeros_like(number)])
            j = open_n
            open_n += 1
            room[j], number[j] = 1.0, len(used)
            used.append(0)
        b = int(number[j])
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        room[j] -= need
        if room[j][0] < smallest - 1e-12 or room[j][1] < 1 / top[1] - 1e-12:
            open_n -= 1  # nothing fits any more: the last open bin takes its place
            room[j], number[j] = room[open_n], number[open_n]
    return bins, offsets


def token_pieces(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and place (of the row in its task): every text's ids and the end id, cut
    only where they exceed the capacity."""
    path = path or default_path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()
    small_batches(docs.sparkSession)

    def run(batches):
        place = 0
        for part, texts in text_groups(batches):
            rows: list[tuple] = []
            for k, ids in enumerate(encoder(path, False).encode(texts)):
                ids += end
                place += 1
                for p, a in enumerate(range(0, len(ids), 4 * capacity)):
                    x = ids[a : a + 4 * capacity]
                    rows.append((k, p, a // 4, len(x) // 4, zlib.crc32(x), place))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0])), *(pa.array(c, pa.int64()) for c in cols[1:])], ["id", "piece", "start", "length", "ids_crc32", "place"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, "id long, piece long, start long, length long, ids_crc32 long, place long")


def pack(docs: DataFrame, capacity: int = 4096, most_docs: int | None = None, most_cost: float | None = None, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1, by: str = "norm") -> DataFrame:
    """Packs every text into sequences of at most `capacity` tokens, `most_docs` pieces and `most_cost` attention cost
    (sum of squared lengths); the last two default to bounds that the first one implies. Within these, sequences of at most
    PREFERRED times the mean number of pieces and the mean cost are preferred, so that both decide which bin is taken and
    cost no sequences.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset, gapless from 0 in each sequence. Null and
    empty texts are their end id alone; null ids stay, repeated rows are packed as often as they stand; other columns,
    whatever their names, are not read; an empty table gives an empty result. Full pieces are sequences of their own.
    The others, at most one for each text, are dealt by hash into groups of about GROUP_PIECES, each packed by one task
    in bounded memory; a group wastes at most the room in its last few bins.
    """
    docs_cap, cost_cap = most_docs or capacity, most_cost or float(capacity) ** 2
    if cost_cap < float(capacity) ** 2 or docs_cap < 1:
        # A full piece alone must fit, as pieces are cut by tokens only.
        raise ValueError("most_cost must be at least capacity ** 2 and most_docs at least 1")
    pieces = written(token_pieces(docs, capacity, id_col, text_col, path, end_id), "pieces")
    full = pieces.where(F.col("length") == capacity).select("id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    known = rest.agg(F.count("*").alias("n"), F.sum("length").alias("tokens"), F.sum(F.col("length").cast("double") ** 2).alias("cost")).first()
    groups = max(1, -(-known["n"] // GROUP_PIECES))
    fewest = max(1, -(-(known["tokens"] or 0) // capacity))
    preferred = (PREFERRED * max(1, known["n"]) / fewest, PREFERRED * (known["cost"] or 1.0) / fewest)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("place", "ascending"), ("piece", "ascending")])
        bins, offsets = vector_best_fit(table.column("length").to_numpy(), (capacity, docs_cap, cost_cap), by=by, preferred=preferred)
        group = table.column("group")[0].as_py()
        keep = table.select(["id", "piece", "start", "length", "ids_crc32"])
        return keep.append_column("sequence_id", pa.array(bins * groups + group)).append_column("offset", pa.array(offsets))

    dealt = rest.withColumn("group", F.pmod(F.xxhash64("id", "piece", "place", "ids_crc32"), F.lit(groups)))
    out = dealt.groupBy("group").applyInArrow(run, "id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return full.unionByName(out).withColumnRenamed("id", id_col)
