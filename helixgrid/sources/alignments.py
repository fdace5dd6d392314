"""SAM text, transcripts and fragment files as DataFrames, and the sinks of alignments, fragments and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import revcomp, strip_mate_suffix
from ..operators.fragments import fragment_line, ordered_fragments, parse_fragments
from ..operators.storage import materialized
from ..operators.transcriptome import indexed_rows
from .bam import read_bam, write_bam
from .containers import kind_of, list_files
from .parts import write_lines


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """name, flags, chrom, pos (1-based), mapq (255: null), cigar, seq, qual, md, barcode (CB), raw_barcode (CR), umi (UB or
    UR), mate and mate_chrom of SAM text. Stars are null."""
    x = F.split("value", "\t")
    at = lambda i: F.nullif(F.get(x, F.lit(i)), F.lit("*"))
    tag = lambda t: F.nullif(F.regexp_extract("value", rf"\t{t}:[A-Z]:([^\t]*)", 1), F.lit(""))
    flags = at(1).cast("int")
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '@')")
    return rows.select(
        strip_mate_suffix(at(0)).alias("name"), flags.alias("flags"), at(2).alias("chrom"), at(3).cast("long").alias("pos"), F.nullif(at(4).cast("int"), F.lit(255)).alias("mapq"), at(5).alias("cigar"),
        at(9).alias("seq"), at(10).alias("qual"), tag("MD").alias("md"), tag("CB").alias("barcode"), tag("CR").alias("raw_barcode"), F.coalesce(tag("UB"), tag("UR")).alias("umi"),
        F.when(flags.bitwiseAND(128) != 0, 2).otherwise(1).alias("mate"), F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("mate_chrom"),
    )


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, length of the sequences in a SAM header."""
    rows = spark.read.text(path).where("startswith(value, '@SQ')").withColumn("at", F.monotonically_increasing_id())
    kept = rows.select("at", F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))
    from pyspark.sql import Window

    return kept.select((F.row_number().over(Window.orderBy("at")) - 1).alias("ord"), "name", "length")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """transcript_id, gene_id, gene_name, chrom, start, end, strand, exons (sorted, 0-based, half-open) of a GTF file."""
    x = F.split("value", "\t")
    attr = lambda k: F.nullif(F.regexp_extract(F.get(x, F.lit(8)), rf'{k} "([^"]*)"', 1), F.lit(""))
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '#')")
    exons = rows.where(F.get(x, F.lit(2)) == "exon").select(F.get(x, F.lit(0)).alias("chrom"), (F.get(x, F.lit(3)).cast("long") - 1).alias("start"), F.get(x, F.lit(4)).cast("long").alias("end"), F.get(x, F.lit(6)).alias("strand"), attr("transcript_id").alias("transcript_id"), attr("gene_id").alias("gene_id"), attr("gene_name").alias("gene_name"))
    e = F.array_sort(F.collect_list(F.struct("start", "end")))
    return exons.groupBy("transcript_id", "gene_id", "chrom", "strand").agg(F.first("gene_name", True).alias("gene_name"), F.min("start").alias("start"), F.max("end").alias("end"), e.alias("exons")).withColumn("gene_name", F.coalesce("gene_name", "gene_id"))


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    return parse_fragments(spark.read.text(path))


def write_fragments(fragments: DataFrame, path: str, header: dict[str, str] | None = None, compression: str = "gzip") -> None:
    """A folder of fragment files, in the order of cells and places, with variants where the table has them. One after the
    other they are one fragment file, with the header's lines in front; gzip is written in BGZF blocks."""
    lines = ordered_fragments(fragments).select(fragment_line("snv1" in fragments.columns).alias("value"))
    write_lines(lines, path, "\n".join(f"# {k}={v}" for k, v in (header or {}).items()), ".tsv", compression)


def sam_line() -> Column:
    """An alignment as a line of SAM text, tags for MD, barcodes and UMI where there are any."""
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    tag = lambda t, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{t}:Z:"), F.col(c)))
    return F.concat_ws("\t", "name", F.col("flags").cast("string"), star("chrom"), F.coalesce(F.col("pos").cast("string"), F.lit("0")), F.coalesce(F.col("mapq").cast("string"), F.lit("255")), star("cigar"), F.lit("*"), F.lit("0"), F.lit("0"), star("seq"), star("qual"), tag("MD", "md"), tag("CR", "raw_barcode"), tag("CB", "barcode"), tag("UR", "umi"))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of BAM files or SAM text, told by the first bytes of the first file."""
    is_bam = kind_of(list_files(path)[0][0]) == "gzip"
    return read_bam(spark, path) if is_bam else read_sam(spark, path)


def write_alignments(alignments: DataFrame, path: str, as_text: bool = False, references: DataFrame | None = None) -> None:
    """Alignments as Parquet, as a folder of SAM text, or, with the sequences they lie on (ord, name, length), as BAM files."""
    if references is not None:
        write_bam(alignments, path, references)
    elif as_text:
        alignments.select(sam_line().alias("value")).write.text(path)
    else:
        alignments.write.parquet(path)


def write_counts(counts: DataFrame, genes: DataFrame, path: str, coverage: DataFrame | None = None, references: DataFrame | None = None) -> None:
    """A count table as Parquet triples, a folder for each layer, beside the genes, the coverage (barcode, linear, size; in
    the order of cells and places) and the reference sequences with their lengths, if these are given."""
    root = path.rstrip("/")
    counts.write.partitionBy("layer").parquet(f"{root}/counts")
    genes.write.parquet(f"{root}/genes")
    if coverage is not None:
        coverage.repartitionByRange("barcode", "linear").sortWithinPartitions("barcode", "linear", "size").write.parquet(f"{root}/coverage")
    if references is not None:
        references.write.parquet(f"{root}/references")


def write_matrix(counts: DataFrame, genes: DataFrame, path: str, compression: str = "gzip") -> None:
    """A layer of counts (barcode, gene_idx, value) as the three files that matrix readers know: matrix.mtx (MatrixMarket,
    genes by cells, counted from 1, in the order of cells and genes), barcodes.tsv and features.tsv (gene_id, gene_name).
    Each is a folder of files that one after the other are one file. Cells stand in the order of barcodes; genes without
    counts have their lines too."""
    root = path.rstrip("/")
    rows = materialized(indexed_rows(counts))
    total = rows.agg(F.count("*").alias("cells"), F.coalesce(F.sum(F.size("cols")), F.lit(0)).alias("entries")).first()
    entries = rows.select("row_idx", F.explode(F.arrays_zip("cols", "vals")).alias("x")).select("row_idx", F.col("x.cols").alias("col"), F.col("x.vals").alias("val")).orderBy("row_idx", "col")
    header = f"%%MatrixMarket matrix coordinate integer general\n{genes.count()} {total.cells} {total.entries}"
    write_lines(entries.select(F.concat_ws(" ", F.col("col") + 1, F.col("row_idx") + 1, "val").alias("value")), f"{root}/matrix.mtx", header, ".mtx", compression)
    write_lines(rows.orderBy("row_idx").select("barcode"), f"{root}/barcodes.tsv", "", ".tsv", compression)
    write_lines(genes.orderBy("gene_idx").select(F.concat_ws("\t", "gene_id", F.coalesce("gene_name", "gene_id")).alias("value")), f"{root}/features.tsv", "", ".tsv", compression)


def collated_pairs(alignments: DataFrame) -> DataFrame:
    """name, r1, r2: the two primary reads of every name, as structs; a name with more than one of either fails."""
    s = F.struct(*[c for c in alignments.columns if c != "name"])
    first = F.col("flags").bitwiseAND(128) == 0
    one = lambda on: F.when(F.count_if(on) > 1, F.raise_error(F.lit("more than one read of a pair has the same name")).cast("string"))
    out = alignments.groupBy("name").agg(F.first(F.when(first, s), True).alias("r1"), F.first(F.when(~first, s), True).alias("r2"), F.coalesce(one(first), one(~first)).alias("_check"))
    return out.where(F.col("_check").isNull()).drop("_check")


def primary_reads(alignments: DataFrame) -> DataFrame:
    """Unmapped reads, and mapped ones that are neither secondary nor supplementary."""
    return alignments.where("(flags & 4) <> 0 or (flags & 2304) = 0")


def alignments_to_fastq(alignments: DataFrame) -> DataFrame:
    """name, r1, r2 and index (structs of seq and qual) of paired alignments: reads on the reverse strand are turned back;
    the index read is the raw barcode with the best qualities that are known (the corrected one otherwise)."""
    back = F.col("flags").bitwiseAND(16) != 0
    turned = primary_reads(alignments).withColumns({"seq": F.when(back, revcomp("seq")).otherwise(F.col("seq")), "qual": F.when(back, F.reverse("qual")).otherwise(F.col("qual"))})
    pairs = collated_pairs(turned.select("name", "flags", "seq", "qual", "raw_barcode", "barcode"))
    bc = F.coalesce("r1.raw_barcode", "r1.barcode", "r2.raw_barcode", "r2.barcode")
    read = lambda r: F.when(F.col(r).isNotNull(), F.struct(F.col(f"{r}.seq").alias("seq"), F.col(f"{r}.qual").alias("qual")))
    return pairs.select("name", read("r1").alias("r1"), read("r2").alias("r2"), F.when(bc.isNotNull(), F.struct(bc.alias("seq"), F.regexp_replace(bc, ".", "~").alias("qual"))).alias("index"))


def multimaps(alignments: DataFrame) -> DataFrame:
    """Adds is_primary, aln_idx (0 for the primary, others in the order of place) and is_multi to alignments. Of each read
    (name, mate) exactly one record must not be secondary."""
    from pyspark.sql import Window

    read = Window.partitionBy("name", "mate")
    primary = F.col("flags").bitwiseAND(256) == 0
    marked = alignments.withColumn("is_primary", primary).withColumn("_n", F.count("*").over(read)).withColumn("_p", F.sum(primary.cast("int")).over(read))
    order = read.orderBy(F.desc("is_primary"), "chrom", "pos", "flags")
    ok = F.when(F.col("_p") != 1, F.raise_error(F.concat(F.lit("not exactly one primary alignment: "), F.col("name"))).cast("int")).otherwise(F.row_number().over(order) - 1)
    return marked.withColumn("aln_idx", ok).withColumn("is_multi", F.col("_n") > 1).drop("_n", "_p")


def confidently_mapped() -> Column:
    return ~F.col("is_multi") & (F.col("flags").bitwiseAND(4) == 0)


def proper_pair(flags1: Column, chrom1: Column, start1: Column, flags2: Column, chrom2: Column, start2: Column, template: Column, most: int = 1000) -> Column:
    """Both mapped to one sequence, on opposite strands, with a template of at most `most` bases."""
    mapped = (flags1.bitwiseAND(4) == 0) & (flags2.bitwiseAND(4) == 0)
    return mapped & (chrom1 == chrom2) & (flags1.bitwiseAND(16) != flags2.bitwiseAND(16)) & (F.abs(template) <= most)
