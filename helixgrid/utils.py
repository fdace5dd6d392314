"""FASTQ tools: stripping barcodes from names, demultiplexing, alignments back to reads, checksums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.barcodes import unique_barcode
from .sources import alignments as A
from .sources import fastq as FQ


def strip_barcodes(reads: DataFrame, pattern: str, groups: dict[str, int], total_groups: int, from_description: bool = False) -> DataFrame:
    """Takes the captured groups of a pattern out of names (or descriptions) and returns those that `groups` names by
    number, each as a column. A read that doesn't match fails. All captured groups leave the text, asked for or not."""
    where = "descr" if from_description else "name"
    rest, found = FQ.strip_groups(F.col(where), pattern, total_groups)
    ok = F.when(rest.isNull(), F.raise_error(F.concat(F.lit("no match: "), F.col(where))).cast("string")).otherwise(rest)
    return reads.withColumns({k: found[i - 1] for k, i in groups.items()}).withColumn(where, ok)


def strip_barcode_from_fastq(spark: SparkSession, fastq: str, out_dir: str, pattern: str, groups: dict[str, int], total_groups: int, from_description: bool = False) -> None:
    """Writes the stripped reads to out_dir/reads and each group, with the best qualities, to out_dir/<name of the group>."""
    found = strip_barcodes(FQ.read_fastq(spark, fastq), pattern, groups, total_groups, from_description)
    FQ.write_fastq(found, f"{out_dir}/reads")
    for k in groups:
        FQ.write_fastq(found.where(F.col(k).isNotNull()), f"{out_dir}/{k}", "name", k, None)


def extract_barcode_from_name(reads: DataFrame, rename: Callable[[str], str] | None, get_barcode: Callable[[str], str | None]) -> DataFrame:
    """Adds barcode, and renames reads, by the caller's own functions of "name description", run over Arrow batches."""
    full = F.concat_ws(" ", "name", F.nullif("descr", F.lit("")))
    own = F.pandas_udf(lambda s: s.map(get_barcode), "string")
    out = reads.withColumn("barcode", own(full))
    if rename:
        named = F.pandas_udf(lambda s: s.map(rename), "string")
        out = out.withColumn("name", named(full)).withColumn("descr", F.lit(""))
    return out


def multiplex_fastq(spark: SparkSession, first: list[str], second: list[str] | None, out_dir: str) -> None:
    """One set of files out of many: the i-th file's reads carry the i-th base-4 barcode, which goes to out_dir/I1; names of
    mates must agree."""
    reads = {"R1": FQ.read_fastq(spark, first)} | ({"R2": FQ.read_fastq(spark, second)} if second else {})
    both = FQ.lockstep(reads).join(reads["R1"].select("rec_idx", unique_barcode("file_idx", len(first)).alias("barcode")), "rec_idx")
    for k in reads:
        FQ.write_fastq(both.select("rec_idx", "name", f"{k}.seq", f"{k}.qual"), f"{out_dir}/{k}")
    FQ.write_fastq(both, f"{out_dir}/I1", "name", "barcode", None)


def bam_to_fastq(spark: SparkSession, path: str, out_dir: str) -> None:
    """Reads of paired alignments in BAM files or SAM text, turned back to their own strand, with the barcode as index read, in the order of names."""
    pairs = A.alignments_to_fastq(A.read_alignments(spark, path))
    for k, name in (("r1", "R1"), ("r2", "R2"), ("index", "I1")):
        one = pairs.where(F.col(k).isNotNull()).select("name", f"{k}.seq", f"{k}.qual")
        FQ.write_fastq(one, f"{out_dir}/{name}", order="name")


sam_to_fastq = bam_to_fastq


def file_md5(spark: SparkSession, path: str) -> dict[str, str]:
    """Hex MD5 of files, by their names."""
    rows = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("md5"))
    return {r["name"]: r["md5"] for r in rows.collect()}


__all__ = ["bam_to_fastq", "extract_barcode_from_name", "file_md5", "multiplex_fastq", "sam_to_fastq", "strip_barcode_from_fastq", "strip_barcodes"]
