"""Running tables over streams of reads and fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.barcodes import barcode_histogram
from ..operators.fragments import fingerprint_groups, fingerprint_keys, fragment_qc, shifted_fragments


def running_histogram(reads: DataFrame, name: str, keys: list[str] = (), barcode: str = "barcode") -> StreamingQuery:
    """Keeps the barcode histogram of a stream in an in-memory table of that name (for tests and small views)."""
    return barcode_histogram(reads, list(keys), barcode).writeStream.outputMode("complete").format("memory").queryName(name).start()


def windowed_reads(reads: DataFrame, time: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Reads for each window of event time and key; windows close when the watermark has passed them."""
    found = reads.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def fragment_qc_to(fragments: DataFrame, path: str, checkpoint: str, mito: list[str] = ()) -> StreamingQuery:
    """Writes every batch's fragment metrics under its number; a repeated batch replaces its own row."""

    def put(batch: DataFrame, number: int) -> None:
        fragment_qc(batch, list(mito)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return fragments.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def running_fragments(reads: DataFrame, path: str, checkpoint: str, umi: str | None = None, name: str = "name") -> StreamingQuery:
    """Removes duplicates of a stream of reads as `unique_fragments` does of a table: Spark keeps each fingerprint's count and
    smallest read as state, and every batch writes the fingerprints that it changed under its number. A batch that is
    repeated after a restart replaces its own rows. Counts and smallest reads do not depend on the order of batches."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return fingerprint_groups(reads, umi, name).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_fragments(spark: SparkSession, path: str, shift_left: int = 0, shift_right: int = 0, umi: str | None = None) -> DataFrame:
    """The fragments of what `running_fragments` has written so far: each fingerprint as the last batch that changed it left
    it. Ends are shifted here and not in the stream, as a later read can still change them."""
    keys = fingerprint_keys(umi)
    last = spark.read.parquet(path).groupBy(*keys).agg(F.max_by(F.struct("count", "f"), "batch").alias("x"))
    return shifted_fragments(last.select(*keys, "x.*"), shift_left, shift_right)
