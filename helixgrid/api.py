"""Whole runs: layouts and FASTQ files to annotated reads, alignments, fragments or count tables, with metrics."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.seq import revcomp, spliced_segments
from .operators import barcodes as B
from .operators import fragments as G
from .operators import intervals as I
from .operators import qc as Q
from .operators import segments as M
from .operators import snv as V
from .operators import transcriptome as T
from .operators.aligner import Aligner, align_reads
from .operators.storage import materialized
from .plans.layout import Assay, FileRef, LayoutError
from .sources import alignments as A
from .sources import fastq as FQ

OUTPUTS = ("alignment", "fragment", "gene_quantification")


@dataclass
class Run:
    """Tables of a run: what was asked for, and its metrics by name."""

    output: DataFrame
    metrics: dict[str, DataFrame] = field(default_factory=dict)
    genes: DataFrame | None = None
    #: Of a gene by cell table: barcode, linear (index of a fragment's 5' end in the genome) and size.
    coverage: DataFrame | None = None
    #: ord, name, length and offset of the reference sequences.
    references: DataFrame | None = None


def _parts(split: DataFrame, read_id: str, regions: list[str], reverse: bool) -> dict[str, Column]:
    """Columns of one read's barcode regions, UMI and target."""
    x = lambda region: F.get(F.filter(f"{read_id}.segments", lambda e: e["region_id"] == region), F.lit(0))
    turn = (lambda s: revcomp(s)) if reverse else (lambda s: s)
    back = (lambda q: F.reverse(q)) if reverse else (lambda q: q)
    out = {}
    for r in regions:
        s = x(r)
        out[f"bc_{r}"], out[f"bq_{r}"] = turn(s["seq"]), back(s["qual"])
    return out


#: Reads that are looked at when a layout is checked, and the tolerance of fixed sequences then.
SAMPLE, SAMPLE_TOLERANCE = 1000, 0.2


def _warn_of_layout(spark: SparkSession, read_id: str, reads: DataFrame, layout: list[M.Element], onlists: dict, reverse: bool) -> None:
    """Warns if fewer than half of a file's first reads fit the layout, or of their barcodes stand on the list."""
    sample = M.split_reads(reads.limit(SAMPLE), layout, ["rec_idx"], reverse=reverse, linker_tolerance=SAMPLE_TOLERANCE, anchor_tolerance=SAMPLE_TOLERANCE)
    lists = {e.region_id: FQ.read_onlist(spark, onlists[e.region_id].url) for e in layout if e.region_type == "barcode" and onlists.get(e.region_id)}
    for what, share in M.layout_sample(sample, lists, SAMPLE, reverse).items():
        if share < 0.5:
            warnings.warn(f"{read_id}: only {share:.0%} of the first reads " + ("fit the layout" if what == "fits" else f"have a barcode on the list of {what}"), stacklevel=3)


def annotated_reads(spark: SparkSession, assay: Assay, modality: str | None = None, threshold: float = 0.9, distance: int = 1, max_expected_errors: float | None = None, call_cells: bool = True, verify: bool = True) -> tuple[DataFrame, dict[str, DataFrame]]:
    """name, barcode, barcode_qual, corrected, umi, umi_qual, r1, r2 of an assay's reads, and metrics.

    Every barcode region is counted and corrected against its own list (or its own plausible barcodes, where it has none);
    a read is corrected if all of its regions are. Files that carry neither barcode, UMI nor target are not read. Without a
    list, and with `call_cells`, a region's barcodes below the order-of-magnitude threshold are not plausible. With `verify`
    the first reads are held against the layout and the lists, and a share below one half gives a warning.
    """
    m = modality or assay.modality()
    layouts = assay.segments_by_modality(m, needed_only=True)
    layouts = {k: v for k, v in layouts.items() if assay.reads[k].fastqs()}
    if not layouts:
        raise ValueError(f"no read of {m} has FASTQ files and useful segments")
    onlists = assay.onlists(m)
    reads = materialized(FQ.read_lockstep(spark, {k: assay.reads[k].fastqs() for k in layouts}, {k: assay.reads[k].max_len for k in layouts}))
    metrics: dict[str, DataFrame] = {}
    cols: dict[str, Column] = {}
    bars: list[str] = []
    umis: list[tuple[Column, Column]] = []
    targets: list[tuple[str, Column, Column]] = []
    table = reads.select("rec_idx", "name")
    for k, layout in layouts.items():
        rev = assay.reads[k].reverse
        alone = reads.select("rec_idx", F.col(f"{k}.seq").alias("seq"), F.col(f"{k}.qual").alias("qual"))
        part = M.split_reads(alone, layout, ["rec_idx"], reverse=rev)
        if verify:
            _warn_of_layout(spark, k, alone, layout, onlists, rev)
        metrics[f"structure_{k}"] = Q.read_defects(part.select(F.lit(k).alias("read_id"), "status"))
        table = table.join(part.select("rec_idx", F.struct("segments", "status").alias(k)), "rec_idx")
        regions = [e.region_id for e in layout if e.region_type == "barcode"]
        cols |= _parts(table, k, regions, rev)
        bars += regions
        one = lambda test, k=k: F.get(F.filter(f"{k}.segments", test), F.lit(0))
        if any(e.region_type == "umi" for e in layout):
            u = one(lambda e: e["region_type"] == "umi")
            umis.append((revcomp(u["seq"]) if rev else u["seq"], F.reverse(u["qual"]) if rev else u["qual"]))
        if any(e.region_type in M.TARGETS for e in layout):
            t = one(lambda e: M.is_target(e["region_type"]))
            targets.append((k, t["seq"], t["qual"]))
    if len(targets) > 2:
        raise ValueError("more than two reads have a target")
    join = lambda xs: F.concat(*xs) if xs else F.lit(None).cast("string")
    pair = lambda i: F.when(targets[i][1].isNotNull(), F.struct(targets[i][1].alias("seq"), targets[i][2].alias("qual"))) if len(targets) > i else F.lit(None).cast("struct<seq:string,qual:string>")
    flat = materialized(table.select("rec_idx", "name", *(c.alias(n) for n, c in cols.items()), join([u for u, _ in umis]).alias("umi"), join([q for _, q in umis]).alias("umi_qual"), pair(0).alias("r1"), pair(1).alias("r2")))
    for r in bars:
        ref: FileRef | None = onlists.get(r)
        hist = B.barcode_histogram(flat, [], f"bc_{r}")
        least = None
        if not ref and call_cells:
            hist = materialized(hist)
            called = B.ordmag_threshold(hist.where(B.plausible("barcode"))).first()
            least = called["threshold"] if called else None
        counts = materialized(B.whitelist_counts(hist, FQ.read_onlist(spark, ref.url) if ref else None, least))
        metrics[f"barcode_{r}"] = B.whitelist_stats(counts)
        flat = B.correct_barcodes(flat, counts.where("listed").select("barcode", "n"), ["rec_idx"], f"bc_{r}", f"bq_{r}", distance, threshold, max_expected_errors)
        flat = flat.withColumnRenamed("corrected", f"ok_{r}").drop("status", "posterior")
    all_of = lambda p: F.concat(*(F.col(f"{p}_{r}") for r in bars)) if bars else F.lit(None).cast("string")
    out = materialized(flat.select("rec_idx", "name", all_of("bc").alias("barcode"), all_of("bq").alias("barcode_qual"), all_of("ok").alias("corrected"), "umi", "umi_qual", "r1", "r2"))
    metrics["fastq"] = Q.fastq_qc(out.select("barcode_qual", "umi_qual", F.col("r1.qual").alias("q1"), F.col("r2.qual").alias("q2")), {"barcode": "barcode_qual", "umi": "umi_qual", "read1": "q1", "read2": "q2"})
    return out, metrics


def update_read(spark: SparkSession, assay: Assay, read_id: str, fastqs: list[str] | None = None, infer: bool = True, verify: bool = True, **edits) -> list[str]:
    """Adds or changes a read of a layout, as Assay.update_read. Bounds of its length that are not given are those of the
    first records of its files, which are also looked at where only bounds are to be brought up to date. With `verify` a read
    whose primer the library lacks is refused, and the layout stays as it was; the first records of its files are held
    against the read's segments and lists, and a share below one half gives a warning."""
    old = assay.reads.get(read_id)
    files = fastqs if fastqs is not None else (old.fastqs() if old else [])
    table = FQ.read_fastq(spark, files) if files and (infer or verify) else None
    found = assay.update_read(read_id, fastqs=fastqs, lengths=M.infer_lengths(table, sample=SAMPLE) if infer and files else None, **edits)
    read = assay.reads[read_id]
    if verify and assay.region(read.primer_id) is None:
        assay.reads = {k: (old if k == read_id else r) for k, r in assay.reads.items() if k != read_id or old}
        raise LayoutError(f"the library has no region {read.primer_id}, at which {read_id} would begin")
    layout = assay.segments(read_id) if verify and files else []
    if layout:
        _warn_of_layout(spark, read_id, table.select("rec_idx", "seq", "qual"), layout, assay.onlists(read.modality), read.reverse)
    return found


def make_fastq(spark: SparkSession, assay: Assay, out_dir: str, modality: str | None = None, correct_barcode: bool = False) -> dict[str, DataFrame]:
    """Writes R1 (barcode, UMI and first read) and, for pairs, R2; with `correct_barcode` reads that can't be corrected go."""
    reads, metrics = annotated_reads(spark, assay, modality)
    both = FQ.consolidated(reads, correct_barcode)
    FQ.write_fastq(both, f"{out_dir}/R1", "name", "seq1", "qual1", order="name")
    paired = both.where("seq2 is not null")
    if not paired.isEmpty():
        FQ.write_fastq(paired, f"{out_dir}/R2", "name", "seq2", "qual2", order="name")
    return metrics


def _fragments(primary: DataFrame, umi: bool, shifts: tuple[int, int], least_mapq: int, variants: bool) -> DataFrame:
    """Unique fragments of primary alignments: of pairs, and of reads that have no mate."""
    placed = G.with_extents(primary.where((F.col("flags").bitwiseAND(4) == 0) & F.col("barcode").isNotNull()))
    snvs = F.lit(None).cast("array<struct<position:bigint,kind:string,length:int,bases:string>>")
    if variants:
        placed = V.call_variants(placed, *placed.columns).drop("text", "error")
    else:
        placed = placed.withColumn("snvs", snvs)
    side = F.struct("flags", "mapq", "chrom", "start", "end", "unclipped_start", "unclipped_end", "snvs")
    mate = lambda k: F.first(F.when(F.coalesce("mate", F.lit(1)) == k, side), ignorenulls=True)
    both = placed.groupBy("name", "barcode", "umi").agg(mate(1).alias("r1"), mate(2).alias("r2"))
    kept = ["barcode", "umi", "chrom", "left_5p", "right_5p", "orientation"]
    spans = lambda *names: [c for k in (1, 2) for c in ((F.col(f"{names[k - 1]}.start") - 1, F.col(f"{names[k - 1]}.end"), F.col(f"{names[k - 1]}.snvs")) if k <= len(names) else (F.lit(None).cast("long"), F.lit(None).cast("long"), snvs))]
    named = lambda cols: [c.alias(n) for c, n in zip(cols, ("s1", "e1", "v1", "s2", "e2", "v2"), strict=True)]
    pairs = G.pair_fingerprint(both.where(F.col("r1").isNotNull() & F.col("r2").isNotNull() & (F.col("r1.chrom") == F.col("r2.chrom"))).where(G.pair_passes(least=least_mapq)))
    pairs = pairs.withColumn("chrom", F.col("r1.chrom")).select("name", *kept, *(c.alias(n) for n, c in G.pair_coordinates().items()), *named(spans("r1", "r2")))
    one = both.where(F.col("r2").isNull() & F.col("r1").isNotNull() & (F.col("r1.flags").bitwiseAND(1) == 0)).select("name", "barcode", "umi", "r1", "r1.*").where(G.read_passes(least=least_mapq))
    single = G.single_fingerprint(one).select("name", *kept, *(c.alias(n) for n, c in G.single_coordinates().items()), *named(spans("r1")))
    reads = pairs.unionByName(single)
    if not variants:
        return G.unique_fragments(reads, *shifts, umi="umi" if umi else None)
    keys = kept if umi else [k for k in kept if k != "umi"]
    reads = materialized(reads)
    out = G.unique_fragments(reads, *shifts, umi="umi" if umi else None, keep=[k for k in keys if k not in ("barcode", "chrom")])
    for k in (1, 2):
        piles = G.variant_pileup(reads.where(F.col(f"s{k}").isNotNull()), keys, f"s{k}", f"e{k}", f"v{k}").select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("read_start").alias(f"read_start{k}"), F.col("pileup").alias(f"snv{k}"))
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.join(piles, same, "left").drop(*(f"_{c}" for c in keys))
    return out.drop(*(k for k in keys if k not in ("barcode", "chrom")))


def align(
    spark: SparkSession, assay: Assay | list[Assay], aligner: Aligner, output: str, *, modality: str | None = None, transcripts: DataFrame | None = None, mito_dna: list[str] = (), shift_left: int = 4, shift_right: int = -5, strandedness: str | None = None,
    least_mapq: int = 30, mismatch: int = 1, confidence: float = 0.9, max_expected_errors: float | None = None, call_cells: bool = True, compute_snv: bool = False, verify: bool = True,
) -> Run:
    """Aligns the reads of one or several assays and returns alignments, unique fragments or a gene by cell table.

    Barcodes may differ from their list in `mismatch` places and need a posterior of `confidence`. Duplicates of a fragment
    agree in the UMI too, where the assay has one. `compute_snv` adds the reads' variants to fragments. The gene by cell
    table comes with the coverage of its molecules. Written results take a compression at the sinks.
    """
    if output not in OUTPUTS:
        raise ValueError(f"output must be one of {OUTPUTS}")
    assays = assay if isinstance(assay, list) else [assay]
    parts, metrics = [], {}
    for i, a in enumerate(assays):
        reads, found = annotated_reads(spark, a, modality, confidence, mismatch, max_expected_errors, call_cells, verify)
        parts.append(reads)
        metrics |= {f"{k}_{i}" if len(assays) > 1 else k: v for k, v in found.items()}
    reads = FQ.concat_assays(*parts).withColumn("name", F.concat_ws(":", "assay_idx", "name"))
    some = reads.where("r1 is not null or r2 is not null")
    first = F.coalesce("r1", "r2")  # a read whose first mate is missing goes alone
    second = F.when(F.col("r1").isNotNull(), F.col("r2"))
    given = some.select("name", first["seq"].alias("seq1"), first["qual"].alias("qual1"), second["seq"].alias("seq2"), second["qual"].alias("qual2"))
    tags = reads.select("name", F.col("corrected").alias("barcode"), F.col("barcode").alias("raw_barcode"), F.col("barcode_qual").alias("raw_barcode_qual"), "umi", "umi_qual")
    alignments = materialized(A.multimaps(align_reads(given, aligner)).join(tags, "name"))
    primary = alignments.where("is_primary")
    metrics["alignment"] = Q.align_qc(primary, list(mito_dna))
    references = I.genome_offsets(spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(aligner.header())], "ord long, name string, length long"))
    if output == "alignment":
        return Run(alignments, metrics, references=references)
    if output == "fragment":
        umi = not reads.where("umi is not null").isEmpty()
        frags = materialized(_fragments(primary, umi, (shift_left, shift_right), least_mapq, compute_snv))
        metrics["fragment"] = G.fragment_qc(frags, list(mito_dna))
        return Run(frags, metrics, references=references)
    if transcripts is None:
        raise ValueError("gene_quantification needs transcripts")
    mate = F.coalesce("mate", F.lit(1))
    mapped = alignments.where((F.col("flags").bitwiseAND(4) == 0) & F.col("barcode").isNotNull())
    back = (F.col("flags").bitwiseAND(16) != 0) != (mate == 2)  # second reads are turned round
    spliced = mapped.select(F.col("name").alias("read_id"), "aln_idx", mate.alias("mate"), "chrom", spliced_segments("pos", "cigar").alias("segments"), F.when(back, "-").otherwise("+").alias("strand"), "is_multi", "is_primary", "barcode", "umi").where(F.size("segments") > 0)
    if strandedness is None:
        strandedness = T.strandedness_vote(spliced.where("not is_multi"), transcripts).first()["strandedness"]
    hits = materialized(T.transcript_hits(spliced.select("read_id", "aln_idx", "mate", "chrom", "segments", "strand"), transcripts, strandedness))
    mates = spliced.groupBy("read_id", "aln_idx").agg(F.countDistinct("mate").alias("n"))
    pairs = mates.where("n = 2").select("read_id", "aln_idx")
    alone = spliced.join(pairs.select("read_id").distinct(), "read_id", "left_anti").select("read_id", "aln_idx")
    only = lambda of: hits.join(of.select("read_id").distinct(), "read_id", "left_semi")
    genes_of = materialized(T.resolve_pairs(pairs, only(pairs)).unionByName(T.resolve_single(alone, only(alone))))
    metrics["gene"] = Q.gene_qc(genes_of)
    genes = T.gene_index(transcripts)
    tagged = genes_of.where("kind = 'aligned'").join(tags.select(F.col("name").alias("read_id"), "barcode", "umi"), "read_id").join(genes.select("gene_id", "gene_idx"), "gene_id")
    cells = ["barcode", "gene_idx"]
    assigned = materialized(T.molecules(tagged, cells))
    molecules = materialized(T.annotate_molecules(assigned, cells))
    metrics["quantification"] = Q.quantification_qc(molecules)
    parts = spliced.where("is_primary").select("read_id", "chrom", "strand", F.explode("segments").alias("s")).select("read_id", "chrom", "strand", "s.start", "s.end")
    covered = T.molecule_fragments(materialized(parts.join(assigned.select("read_id", *cells, "molecule"), "read_id")), cells)
    return Run(T.count_layers(molecules), metrics, genes, I.coverage_values(covered, references), references)


def metrics_dict(metrics: dict[str, DataFrame]) -> dict:
    """The metrics' few rows as plain Python values."""
    out = {}
    for k, df in metrics.items():
        rows = [r.asDict(recursive=True) for r in df.collect()]
        out[k] = rows[0] if len(rows) == 1 else rows
    return out


__all__ = ["OUTPUTS", "Run", "align", "annotated_reads", "make_fastq", "metrics_dict", "update_read"]
