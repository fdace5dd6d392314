"""Alignment filters, duplicate removal and fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import clip_after, clip_before, five_prime, reference_length

#: Flags of reads that are left out: unmapped, mate unmapped, secondary, failed, duplicate, supplementary.
UNWANTED_FLAGS = 3852
PROPER_PAIR, REVERSE, FIRST = 2, 16, 64


def _has(flags: Column | str, bit: int) -> Column:
    return (F.col(flags) if isinstance(flags, str) else flags).bitwiseAND(bit) != 0


def read_passes(flags: str = "flags", mapq: str = "mapq", least: int = 30) -> Column:
    """No unwanted flag, and a mapping quality of at least `least` (255 where it is unknown)."""
    return ~_has(flags, UNWANTED_FLAGS) & (F.coalesce(F.col(mapq), F.lit(255)) >= least)


def pair_passes(first: str = "r1", second: str = "r2", least: int = 30) -> Column:
    """Both reads pass and the first is properly paired."""
    return read_passes(f"{first}.flags", f"{first}.mapq", least) & read_passes(f"{second}.flags", f"{second}.mapq", least) & _has(f"{first}.flags", PROPER_PAIR)


def with_extents(alignments: DataFrame, pos: str = "pos", cigar: str = "cigar") -> DataFrame:
    """Adds start and end of the aligned part (1-based, inclusive) and both without clipping."""
    end = (F.col(pos) + reference_length(cigar) - 1).cast("long")
    return alignments.withColumns({"start": F.col(pos).cast("long"), "end": end, "unclipped_start": (F.col(pos) - clip_before(cigar)).cast("long"), "unclipped_end": end + clip_after(cigar)})


def single_fingerprint(reads: DataFrame) -> DataFrame:
    """Adds the key of duplicates of single reads: left_5p (unclipped), right_5p (null) and orientation F or R."""
    return reads.withColumns({"left_5p": five_prime("unclipped_start", "unclipped_end", "flags"), "right_5p": F.lit(None).cast("long"), "orientation": F.when(_has("flags", REVERSE), "R").otherwise("F")})


def pair_fingerprint(pairs: DataFrame, first: str = "r1", second: str = "r2") -> DataFrame:
    """Adds the key of duplicates of read pairs. The left read is the first one if its unclipped 5' end is strictly
    smaller, else the second; the orientation names both strands from the left, and for equal strands which read is left
    (told by the flag of the first segment)."""
    p = {x: five_prime(f"{x}.unclipped_start", f"{x}.unclipped_end", f"{x}.flags") for x in (first, second)}
    left_is_first = p[first] < p[second]
    pick = lambda field: F.when(left_is_first, F.col(f"{first}.{field}")).otherwise(F.col(f"{second}.{field}"))
    other = F.when(left_is_first, F.col(f"{second}.flags")).otherwise(F.col(f"{first}.flags"))
    left = pick("flags")
    l_rev, r_rev, l_one = _has(left, REVERSE), _has(other, REVERSE), _has(left, FIRST)
    orientation = (
        F.when(l_rev & r_rev, F.when(l_one, "RR").otherwise("FF"))
        .when(~l_rev & ~r_rev, F.when(l_one, "FF").otherwise("RR"))
        .when(l_rev, "RF")
        .otherwise("FR")
    )
    return pairs.withColumns({"left_5p": F.least(p[first], p[second]), "right_5p": F.greatest(p[first], p[second]), "orientation": orientation})


def single_coordinates() -> dict[str, Column]:
    """Fragment of a single read: 0-based, half-open, with its strand."""
    return {"frag_start": F.col("start") - 1, "frag_end": F.col("end"), "strand": F.when(_has("flags", REVERSE), "-").otherwise("+")}


def pair_coordinates(first: str = "r1", second: str = "r2") -> dict[str, Column]:
    """Fragment of a read pair: between the aligned 5' ends, without a strand."""
    a, b = (five_prime(f"{x}.start", f"{x}.end", f"{x}.flags") for x in (first, second))
    return {"frag_start": F.least(a, b) - 1, "frag_end": F.greatest(a, b), "strand": F.lit(None).cast("string")}


def unique_fragments(reads: DataFrame, shift_left: int = 0, shift_right: int = 0, umi: str | None = None, name: str = "name", keep: list[str] = ()) -> DataFrame:
    """chrom, start, end, barcode, count, strand (and the columns `keep` of the fingerprint) of the fragments that are left when duplicates become one.

    `reads` has barcode, chrom, left_5p, right_5p, orientation, frag_start, frag_end, strand and `name`. Duplicates agree
    in all of the fingerprint (and the UMI, nulls alike); the coordinates are those of the smallest (start, end, name), so
    that the result doesn't depend on the order of rows. Ends of pairs are shifted, not below 0; fragments that end up
    empty go. One shuffle, after partial aggregation, on barcode and fingerprint: a cell with very many reads is spread
    by its fragments.
    """
    return shifted_fragments(fingerprint_groups(reads, umi, name), shift_left, shift_right, keep)


def fingerprint_keys(umi: str | None = None) -> list[str]:
    return ["barcode", "chrom", "left_5p", "right_5p", "orientation", *([umi] if umi else [])]


def fingerprint_groups(reads: DataFrame, umi: str | None = None, name: str = "name") -> DataFrame:
    """A row for each fingerprint: count, and f, the smallest (frag_start, frag_end, name, strand). Reads may be a stream."""
    first = F.min(F.struct("frag_start", "frag_end", F.col(name).alias("name"), "strand"))
    return reads.where(F.col("barcode").isNotNull()).groupBy(*fingerprint_keys(umi)).agg(F.count("*").alias("count"), first.alias("f"))


def shifted_fragments(groups: DataFrame, shift_left: int, shift_right: int, keep: list[str] = ()) -> DataFrame:
    """The fragments of fingerprints; see unique_fragments."""
    moved = lambda c, by: F.when(F.col("f.strand").isNull(), F.greatest(F.col(c) + by, F.lit(0))).otherwise(F.col(c)).cast("long")
    out = groups.select("chrom", moved("f.frag_start", shift_left).alias("start"), moved("f.frag_end", shift_right).alias("end"), "barcode", "count", F.col("f.strand").alias("strand"), *keep)
    return out.where(F.col("end") > F.col("start"))


def ordered_fragments(fragments: DataFrame) -> DataFrame:
    """Cells together, and within a cell by chrom, start, end, count: sorted within partitions, as a sink needs it."""
    return fragments.repartitionByRange("barcode", "chrom", "start").sortWithinPartitions("barcode", "chrom", "start", "end", "count")


def fragment_line(variants: bool = False) -> Column:
    """A fragment as a line of tab-separated text; missing barcodes and strands are dots. `variants`: the begin and the
    pile-up of each read follow, those of a second read only where there is one."""
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce("barcode", F.lit(".")), F.col("count").cast("string"), F.coalesce("strand", F.lit(".")))
    return F.concat_ws("\t", line, *(F.col(f"{c}{k}").cast("string") for k in (1, 2) for c in ("read_start", "snv"))) if variants else line


def parse_fragments(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fragments of lines of text: a barcode or strand of "." is null, a missing or dotted count is 1; further fields and
    comment lines are left out."""
    x = F.split(column, "\t")
    at = lambda i: F.nullif(F.get(x, F.lit(i)), F.lit("."))
    kept = lines.where(~F.col(column).startswith("#") & (F.col(column) != ""))
    return kept.select(F.get(x, F.lit(0)).alias("chrom"), at(1).cast("long").alias("start"), at(2).cast("long").alias("end"), at(3).alias("barcode"), F.coalesce(at(4).cast("long"), F.lit(1).cast("long")).alias("count"), at(5).alias("strand"))


def fragment_qc(fragments: DataFrame, mito: list[str] = ()) -> DataFrame:
    """One row: num_unique_fragments, frac_duplicates, frac_fragment_in_nucleosome_free_region (under 147 bases) and
    frac_fragment_flanking_single_nucleosome (147 to 294). Mitochondrial fragments count as unique but in neither class.
    Shares without fragments are null."""
    size, nuclear = F.col("end") - F.col("start"), ~F.col("chrom").isin(*mito) if mito else F.lit(True)
    sums = fragments.agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("dup"),
        F.count("*").alias("num_unique_fragments"),
        F.count_if(nuclear & (size < 147)).alias("free"),
        F.count_if(nuclear & (size >= 147) & (size <= 294)).alias("single"),
    )
    share = lambda a, b: F.try_divide(a.cast("double"), b)
    n = F.col("num_unique_fragments")
    return sums.select("num_unique_fragments", share(F.col("dup"), n + F.col("dup")).alias("frac_duplicates"), share(F.col("free"), n).alias("frac_fragment_in_nucleosome_free_region"), share(F.col("single"), n).alias("frac_fragment_flanking_single_nucleosome"))


def read_extents(reads: DataFrame, keys: list[str]) -> DataFrame:
    """The span of all duplicates of a group: read_start and read_end."""
    return reads.groupBy(*keys).agg(F.min("read_start").alias("read_start"), F.max("read_end").alias("read_end"))


def variant_pileup(reads: DataFrame, keys: list[str], start: str, end: str, variants: str) -> DataFrame:
    """keys, read_start and pileup: the span of a duplicate group's reads, 0-based, and its reads' variants as texts over
    this span, as in snv_pileup. `variants`: arrays of (position, kind, length, bases), null or empty for none. Reads of one
    group with the same variants are one row before anything is collected."""
    from .snv import render_variants

    counted = reads.groupBy(*keys, F.coalesce(F.col(variants), F.array().cast("array<struct<position:bigint,kind:string,length:int,bases:string>>")).alias("_v")).agg(F.count("*").alias("n"), F.min(start).alias("_s"), F.max(end).alias("_e"))
    group = Window.partitionBy(*keys)
    spans = counted.withColumns({"read_start": F.min("_s").over(group), "_end": F.max("_e").over(group)})
    moved = F.transform("_v", lambda v: F.struct((v["position"] - F.col("read_start")).alias("axis"), v["kind"].alias("kind"), v["length"].cast("long").alias("n"), v["bases"].alias("bases")))
    texts = spans.withColumn("e", render_variants(moved, F.col("_end") - F.col("read_start"))["text"]).groupBy(*keys, "read_start", "e").agg(F.sum("n").alias("n"))
    return _joined(texts, [*keys, "read_start"])


def _joined(counted: DataFrame, keys: list[str]) -> DataFrame:
    """keys and pileup of texts e with numbers of reads n."""
    joined = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("e", "n"))).alias("x"), F.sum("n").alias("all"))
    line = F.array_join(F.transform("x", lambda r: F.when(r["n"] == F.col("all"), r["e"]).otherwise(F.concat(r["e"], F.lit(":"), r["n"].cast("string")))), ";")
    return joined.select(*keys, line.alias("pileup"))


def snv_pileup(reads: DataFrame, keys: list[str]) -> DataFrame:
    """keys and pileup: the different SNV strings of a duplicate group with their numbers of reads, in order, joined by
    ";". `reads` has snvs (null: none) and length. A read without SNV counts under its length; a number that is the whole
    group's is left out. A group's strings are as many as it has different ones."""
    entry = F.coalesce(F.col("snvs"), F.col("length").cast("string"))
    counted = reads.groupBy(*keys, entry.alias("e")).agg(F.count("*").alias("n"))
    return _joined(counted, keys)
