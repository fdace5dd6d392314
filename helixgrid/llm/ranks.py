"""Exact places of rows in a total order, by sorted ranges and the numbers of rows before each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import written

#: monotonically_increasing_id has the number of a partition above so many bits.
PARTITION_BITS = 33


def with_ranks(df: DataFrame, order: list[str], group: str | None = None, rank: str = "rank") -> DataFrame:
    """Adds `rank` (from 0) within each value of `group`, null being one, in ascending `order`, nulls first; rows that `order` does not tell
    apart get their places in any order. A group of any size is spread over ranges of `order`: rows are sorted within
    ranges and numbered there, and a range's number of rows of each group, summed over the ranges before it, is added.
    `df` is read twice, so it should be a written table. Columns beginning with an underscore are lost."""
    keys = [F.col(c).asc_nulls_first() for c in [*([group] if group else []), *order]]
    columns = [c for c in df.columns if not c.startswith("_")]
    tagged = df.withColumn("_group", F.xxhash64(F.col(group).isNull(), F.col(group)) if group else F.lit(0).cast("long"))
    placed = written(tagged.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "placed")
    ranged = placed.withColumn("_range", F.shiftright("_at", PARTITION_BITS))
    same = ["_group", *([group] if group else [])]
    # A row for each range and group in it: as many as ranges and groups together, whatever the rows.
    counts = ranged.groupBy("_range", *same).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*same).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", *same, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    on = (F.col("r._range") == F.col("o._range")) & (F.col("r._group") == F.col("o._group"))
    if group:
        on &= F.col(f"r.{group}").eqNullSafe(F.col(f"o.{group}"))
    joined = ranged.alias("r").join(offsets.alias("o"), on)
    return joined.select(*[F.col(f"r.{c}") for c in columns], (F.col("r._at") + F.col("o._shift")).alias(rank))
