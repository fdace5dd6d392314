"""Quality metrics: conditional aggregates that combine within tasks before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import q30_bases


def _share(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b)


def fastq_qc(reads: DataFrame, parts: dict[str, str]) -> DataFrame:
    """part, bases, q30_bases and frac_q30_bases for each quality column of `parts` (part: column). Nulls have no bases."""
    pairs = ", ".join(f"'{k}', `{c}`" for k, c in parts.items())
    long = reads.selectExpr(f"stack({len(parts)}, {pairs}) as (part, qual)").where("qual is not null")
    sums = long.groupBy("part").agg(F.sum(F.length("qual")).alias("bases"), F.sum(q30_bases("qual")).alias("q30_bases"))
    return sums.withColumn("frac_q30_bases", _share(F.col("q30_bases"), F.col("bases")))


def read_defects(reads: DataFrame, read_id: str = "read_id", status: str = "status") -> DataFrame:
    """read_id, num_reads, num_defects and frac_reads_with_misformed_structure of segment splits."""
    sums = reads.groupBy(read_id).agg(F.count("*").alias("num_reads"), F.count_if(F.coalesce(F.col(status) != "ok", F.lit(True))).alias("num_defects"))
    return sums.withColumn("frac_reads_with_misformed_structure", _share(F.col("num_defects"), F.col("num_reads")))


def _stat(prefix: str, on: Column) -> list[Column]:
    """Totals of alignments: all, duplicates, mapped, with several places, of high quality."""
    mapped = F.col("flags").bitwiseAND(4) == 0
    multi = F.col("is_multi")
    good = mapped & ~multi & (F.coalesce("mapq", F.lit(60)) >= 30)
    tests = {"total": F.lit(True), "duplicate": F.col("flags").bitwiseAND(1024) != 0, "mapped": mapped, "multimapped": mapped & multi, "high_quality": good}
    return [F.count_if(F.coalesce(on & t, F.lit(False))).alias(f"{prefix}_{k}") for k, t in tests.items()]


def align_qc(reads: DataFrame, mito: list[str] = ()) -> DataFrame:
    """One row of alignment metrics. `reads`: mate (1, 2), flags, mapq, chrom, barcode, is_multi (has other places).

    Shares: properly paired of pairs; of all reads those mapped confidently and those unmapped; of all reads those with a
    barcode; and mitochondrial reads among mapped ones with a barcode. Shares of nothing are null.
    """
    barcoded = F.col("barcode").isNotNull()
    mito_read = barcoded & (F.col("chrom").isin(*mito) if mito else F.lit(False)) & (F.col("flags").bitwiseAND(4) == 0)
    first = F.col("mate") == 1
    paired = F.col("flags").bitwiseAND(1) != 0
    sums = reads.agg(
        *_stat("all", F.lit(True)),
        *_stat("barcoded", barcoded),
        F.count_if(F.coalesce(mito_read, F.lit(False))).alias("mito"),
        F.count_if(first & paired).alias("pairs"),
        F.count_if(first & paired & (F.col("flags").bitwiseAND(2) != 0)).alias("proper"),
    )
    c = F.col
    return sums.select(
        c("all_total").alias("sequenced_reads"),
        c("pairs").alias("sequenced_read_pairs"),
        _share(c("proper"), c("pairs")).alias("frac_properly_paired"),
        _share(c("all_high_quality"), c("all_total")).alias("frac_confidently_mapped"),
        _share(c("all_total") - c("all_mapped"), c("all_total")).alias("frac_unmapped"),
        _share(c("barcoded_total"), c("all_total")).alias("frac_valid_barcode"),
        _share(c("mito"), c("barcoded_mapped")).alias("frac_mitochondrial"),
        _share(c("all_duplicate"), c("all_total")).alias("frac_duplicates"),
        _share(c("all_multimapped"), c("all_total")).alias("frac_multimapped"),
    )


#: Outcomes of a read's way to a gene.
OUTCOMES = ("intergenic", "multimapped", "discordant", "antisense")


def gene_qc(reads: DataFrame) -> DataFrame:
    """One row of mapping shares. `reads`: kind (aligned or one of OUTCOMES), spanning, exonic_only, intronic_only.

    An aligned read counts as spanning, else as exonic, else as intronic, else as mixed."""
    on = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    aligned, kind = F.col("kind") == "aligned", F.col("kind")
    s, e, i = F.col("spanning"), F.col("exonic_only"), F.col("intronic_only")
    sums = reads.agg(
        F.count("*").alias("n"),
        on(aligned).alias("transcriptomic"),
        on(aligned & s).alias("spanning"),
        on(aligned & ~s & e).alias("exonic"),
        on(aligned & ~s & ~e & i).alias("intronic"),
        on(aligned & ~s & ~e & ~i).alias("mixed"),
        *(on(kind == k).alias(k) for k in OUTCOMES),
    )
    kinds = ("intronic", "exonic", "spanning", "mixed", *OUTCOMES)
    return sums.select(_share(F.col("transcriptomic"), F.col("n")).alias("frac_transcriptomic"), *(_share(F.col(k), F.col("n")).alias(f"frac_{k}") for k in kinds))


def quantification_qc(counts: DataFrame) -> DataFrame:
    """One row: num_unique_umi, frac_duplicates, frac_spliced, frac_unspliced of molecules (n_reads, annotation)."""
    sums = counts.agg(F.count("*").alias("u"), F.coalesce(F.sum("n_reads"), F.lit(0)).alias("r"), F.count_if(F.col("annotation") == "spliced").alias("s"), F.count_if(F.col("annotation") == "unspliced").alias("p"))
    c = F.col
    return sums.select(c("u").alias("num_unique_umi"), _share(c("r") - c("u"), c("r")).alias("frac_duplicates"), _share(c("s"), c("u")).alias("frac_spliced"), _share(c("p"), c("u")).alias("frac_unspliced"))
