"""Reads to genes: transcript compatibility, gene resolution, UMI correction, molecules and count tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import merge_intervals, overlap_join
from .storage import materialized

EXONIC, INTRONIC, SPANNING, DISCORDANT = "exonic", "intronic", "spanning", "discordant"
FORWARD, REVERSE, UNSTRANDED = "forward", "reverse", "unstranded"
#: Share of votes in percent beyond which a strandedness is taken.
VOTE = 67.0


def compatibility(segments: Column | str, exons: Column | str) -> Column:
    """How the segments of a read fit a transcript that they overlap.

    With E the exons that the read's span overlaps and S its segments: no E is intronic; one of each is exonic if the exon
    holds the segment, else spanning; equally many must agree at every inner junction (else discordant) and are exonic if
    the outer ends lie within the outer exons, else spanning; more E than S is spanning if the last segment ends within
    or behind the start of the last exon and the first one begins before the first exon's end, else discordant; fewer E
    than S is discordant.
    """
    s = F.col(segments) if isinstance(segments, str) else segments
    e = F.col(exons) if isinstance(exons, str) else exons
    low, high = F.element_at(s, 1)["start"], F.element_at(s, -1)["end"]

    def judge(x: Column) -> Column:
        n, m = F.size(x), F.size(s)
        first_e, last_e, first_s, last_s = F.element_at(x, 1), F.element_at(x, -1), F.element_at(s, 1), F.element_at(s, -1)
        held = (first_s["start"] >= first_e["start"]) & (last_s["end"] <= last_e["end"])
        same = F.forall(
            F.zip_with(x, s, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            lambda p: ((p["a"]["start"] == p["b"]["start"]) | (p["b"]["start"] == first_s["start"])) & ((p["a"]["end"] == p["b"]["end"]) | (p["b"]["end"] == last_s["end"])),
        )
        return (
            F.when(n == 0, INTRONIC)
            .when((n == m) & ((n == 1) | same), F.when(held, EXONIC).otherwise(SPANNING))
            .when(n > m, F.when((last_e["start"] >= last_s["start"]) & (first_e["end"] > first_s["start"]), SPANNING).otherwise(DISCORDANT))
            .otherwise(DISCORDANT)
        )

    over = F.filter(e, lambda x: (x["end"] > low) & (x["start"] < high))
    return F.element_at(F.transform(F.array(over), judge), 1)


def is_antisense(read_strand: Column, transcript_strand: Column, strandedness: str) -> Column:
    if strandedness == FORWARD:
        return read_strand != transcript_strand
    if strandedness == REVERSE:
        return read_strand == transcript_strand
    return F.lit(False)


def transcript_hits(reads: DataFrame, transcripts: DataFrame, strandedness: str = FORWARD, bin_size: int = 10_000) -> DataFrame:
    """Every pair of an alignment and a transcript that overlap, with align_type and antisense.

    `reads`: read_id, aln_idx, mate, chrom, segments, strand (that of the molecule: second reads turned round);
    `transcripts`: transcript_id, gene_id, chrom, start, end, strand, exons.
    """
    spans = reads.withColumns({"start": F.element_at("segments", 1)["start"], "end": F.element_at("segments", -1)["end"]})
    met = overlap_join(spans, transcripts.select("transcript_id", "gene_id", "chrom", "start", "end", "strand", "exons"), bin_size)
    kind, anti = compatibility("segments", "f_exons"), is_antisense(F.col("strand"), F.col("f_strand"), strandedness)
    kept = [c for c in reads.columns if c not in ("chrom", "segments", "strand")]
    return met.select(*kept, F.col("f_transcript_id").alias("transcript_id"), F.col("f_gene_id").alias("gene_id"), kind.alias("align_type"), anti.alias("antisense"))


def _flags(out: DataFrame) -> DataFrame:
    """Adds exonic_only, intronic_only and spanning of an aligned read's hits; no hit at all counts as all of one kind."""
    kinds, aligned = F.transform("hits", lambda h: h["align_type"]), F.col("kind") == "aligned"
    every = lambda k: F.forall(kinds, lambda x: x == k)
    return out.withColumns(
        {
            "exonic_only": aligned & every(EXONIC),
            "intronic_only": aligned & every(INTRONIC),
            "spanning": aligned & F.exists(kinds, lambda x: x == SPANNING) & ~F.exists(kinds, lambda x: x == EXONIC),
        }
    )


def _hits() -> Column:
    return F.array_sort(F.collect_list(F.struct("transcript_id", "align_type")))


def resolve_single(reads: DataFrame, hits: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Gene of each single read: read_id, kind, gene_id, hits, exonic_only, intronic_only, spanning. With `tags`, columns of
    `reads`, there is a row for each row of `reads` instead, with these columns of it.

    Over the sense hits that are not discordant: two genes or more make the read multimapped, one is its gene, with the
    hits of its first alignment that has any. Without such hits a read is intergenic if nothing overlaps; discordant if it
    has several alignments or no good antisense hit; else antisense. A read's hits are as many as its alignments meet
    transcripts.
    """
    own = [F.collect_list(F.struct(*tags)).alias("_tags")] if tags else []
    n = reads.groupBy("read_id").agg((F.min("aln_idx") < F.max("aln_idx")).alias("several"), *own)
    good = ~F.col("antisense") & (F.col("align_type") != DISCORDANT)
    # Smallest of twice an alignment's number, and one more where `holds`: its last bit tells of a read's first alignment
    # with a good hit whether all of its hits hold.
    all_of_first = lambda holds: F.min(F.when(good, F.col("aln_idx").cast("long") * 2 + holds.cast("long"))) % 2 == 1
    kind_is = lambda k: F.col("align_type") == k
    sums = hits.groupBy("read_id").agg(
        F.count_if(good).alias("n_good"),
        F.min(F.when(good, F.col("gene_id"))).alias("g0"),
        F.max(F.when(good, F.col("gene_id"))).alias("g1"),
        F.bool_or(F.col("antisense") & (F.col("align_type") != DISCORDANT)).alias("anti"),
        F.min(F.when(good, F.col("aln_idx"))).alias("first"),
        all_of_first(kind_is(EXONIC)).alias("ex"),
        all_of_first(kind_is(INTRONIC)).alias("it"),
        (all_of_first(~kind_is(EXONIC)) & ~all_of_first(~kind_is(SPANNING))).alias("sp"),
        F.collect_list(F.when(good, F.struct("aln_idx", "transcript_id", "align_type"))).alias("all"),
    )
    met = n.join(sums, "read_id", "left")
    kind = (
        F.when(F.col("n_good").isNull(), "intergenic")
        .when(F.col("n_good") == 0, F.when(F.col("several") | ~F.col("anti"), "discordant").otherwise("antisense"))
        .when(F.col("g0") != F.col("g1"), "multimapped")
        .otherwise("aligned")
    )
    of_first = F.array_sort(F.transform(F.filter("all", lambda x: x["aln_idx"] == F.col("first")), lambda x: F.struct(x["transcript_id"].alias("transcript_id"), x["align_type"].alias("align_type"))))
    empty = F.array().cast("array<struct<transcript_id:string,align_type:string>>")
    aligned = kind == "aligned"
    flag = lambda c: F.coalesce(aligned & F.col(c), F.lit(False))
    out = met.select(
        "read_id", kind.alias("kind"), F.when(aligned, F.col("g0")).alias("gene_id"), F.when(aligned, of_first).otherwise(empty).alias("hits"),
        flag("ex").alias("exonic_only"), flag("it").alias("intronic_only"), flag("sp").alias("spanning"), *(["_tags"] if tags else []),
    )
    return out.select("*", F.inline("_tags")).drop("_tags") if tags else out


def combine_mates(a: Column, b: Column) -> Column:
    """Type of a pair's hit on one transcript from those of its mates."""
    return F.when((a == INTRONIC) & (b == INTRONIC), INTRONIC).when((a == EXONIC) & (b == EXONIC), EXONIC).when((a == DISCORDANT) | (b == DISCORDANT), DISCORDANT).otherwise(SPANNING)


def resolve_pairs(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """Gene of each read pair, as resolve_single. `pairs`: read_id, aln_idx of mates that are both mapped; `hits`: of both
    mates. Mates meet on (read, alignment, transcript) with equal orientation. A read with one gene keeps the hits of its
    first pair, even if that has none."""
    keys = ["read_id", "aln_idx", "transcript_id", "antisense"]
    one = hits.where("mate = 1").select(*keys, "gene_id", F.col("align_type").alias("t1"))
    two = hits.where("mate = 2").select(*keys, F.col("align_type").alias("t2"))
    both = one.join(two, keys).select("read_id", "aln_idx", "transcript_id", "antisense", "gene_id", combine_mates(F.col("t1"), F.col("t2")).alias("align_type"))
    first = pairs.groupBy("read_id").agg(F.min("aln_idx").alias("first"))
    good = ~F.col("antisense") & (F.col("align_type") != DISCORDANT)
    sums = both.groupBy("read_id").agg(
        F.min(F.when(good, F.col("gene_id"))).alias("g0"),
        F.max(F.when(good, F.col("gene_id"))).alias("g1"),
        F.bool_or(F.col("antisense")).alias("anti"),
        F.bool_or(~F.col("antisense") & (F.col("align_type") == DISCORDANT)).alias("disc"),
        F.collect_list(F.when(good, F.struct("aln_idx", "transcript_id", "align_type"))).alias("all"),
    )
    met = first.join(sums, "read_id", "left")
    kind = (
        F.when(F.col("g0") != F.col("g1"), "multimapped")
        .when(F.col("g0").isNotNull(), "aligned")
        .when(F.coalesce("disc", F.lit(False)), "discordant")
        .when(F.coalesce("anti", F.lit(False)), "antisense")
        .otherwise("intergenic")
    )
    of_first = F.array_sort(F.transform(F.filter("all", lambda x: x["aln_idx"] == F.col("first")), lambda x: F.struct(x["transcript_id"].alias("transcript_id"), x["align_type"].alias("align_type"))))
    empty = F.array().cast("array<struct<transcript_id:string,align_type:string>>")
    out = met.select("read_id", kind.alias("kind"), "g0", of_first.alias("x"))
    aligned = F.col("kind") == "aligned"
    return _flags(out.select("read_id", "kind", F.when(aligned, F.col("g0")).alias("gene_id"), F.when(aligned, F.col("x")).otherwise(empty).alias("hits")))


def strandedness_vote(reads: DataFrame, transcripts: DataFrame, bin_size: int = 10_000) -> DataFrame:
    """One row: n_sense, n_antisense and strandedness. A read that lies within a transcript of its strand is sense, else
    within one of the other strand antisense; over VOTE percent of either decides. All rows of `reads` vote."""
    spans = reads.withColumns({"start": F.element_at("segments", 1)["start"], "end": F.element_at("segments", -1)["end"]})
    met = overlap_join(spans.select("read_id", "mate", "chrom", "start", "end", "strand"), transcripts.select("chrom", "start", "end", "strand"), bin_size, contained=True)
    votes = met.groupBy("read_id", "mate").agg(F.bool_or(F.col("strand") == F.col("f_strand")).alias("sense"))
    sums = votes.agg(F.count_if("sense").alias("n_sense"), F.count_if(~F.col("sense")).alias("n_antisense"))
    share = lambda c: F.coalesce(F.try_divide(F.lit(100.0) * F.col(c), F.col("n_sense") + F.col("n_antisense")), F.lit(0.0))
    return sums.withColumn("strandedness", F.when(share("n_sense") > VOTE, FORWARD).when(share("n_antisense") > VOTE, REVERSE).otherwise(UNSTRANDED))


def umi_targets(reads: DataFrame, keys: list[str], umi: str = "umi") -> DataFrame:
    """keys, umi, n, target: every UMI of a group with the one that it is corrected to (itself, if no better).

    The target is the best UMI, by (count, text), that differs in one place, where it has a base of A, C, G, T, and is
    better than the UMI itself; one hop only. UMIs meet in buckets that leave out one place, of which none holds more
    than a few, so that a gene with very many UMIs never becomes all of their pairs. The distinct UMIs of a group are
    shuffled once, before they are put into buckets.
    """
    counts = reads.where(F.col(umi).isNotNull()).groupBy(*keys, F.col(umi).alias("umi")).agg(F.count("*").alias("n")).repartition(*keys)
    at = F.explode_outer(F.when(F.length("umi") > 0, F.sequence(F.lit(1), F.length("umi")))).alias("p")
    holes = counts.select(*keys, "umi", "n", at)
    holes = holes.withColumn("mask", F.concat(F.substr("umi", F.lit(1), F.col("p") - 1), F.lit("*"), F.substr("umi", F.col("p") + 1, F.length("umi"))))
    proper = F.substr("umi", F.col("p"), F.lit(1)).isin(*"ACGT")
    best = F.max(F.when(proper, F.struct("n", "umi"))).over(Window.partitionBy(*keys, "p", "mask"))
    better = F.when(F.col("b") > F.struct("n", "umi"), F.col("b"))
    up = holes.withColumn("b", best).groupBy(*keys, "umi").agg(F.first("n").alias("n"), F.max(better).alias("b"))
    return up.select(*keys, "umi", "n", F.coalesce("b.umi", "umi").alias("target"))


def molecules(reads: DataFrame, keys: list[str], umi: str = "umi", read_id: str = "read_id") -> DataFrame:
    """Adds molecule to reads: the corrected UMI, or one of its own for a read without a UMI."""
    to = umi_targets(reads, keys, umi).select(*keys, F.col("umi").alias(umi), "target")
    own = F.concat(F.lit("#"), F.col(read_id).cast("string"))
    return reads.join(to, [*keys, umi], "left").withColumn("molecule", F.coalesce("target", own)).drop("target")


def annotate_molecules(reads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, molecule, n_reads and annotation of molecules of reads with hits, exonic_only and spanning.

    Any spanning read makes a molecule unspliced, only exonic ones spliced; else it is unspliced if every transcript that
    it hits has an intronic or spanning hit, else ambiguous.
    """
    ids = [*keys, "molecule"]
    # Distinct lists of hits, of which a gene has few however many reads it has.
    seen = F.collect_set(F.transform("hits", lambda h: F.struct(h["transcript_id"].alias("t"), h["align_type"].isin(INTRONIC, SPANNING).alias("in"))))
    sums = reads.groupBy(*ids).agg(F.count("*").alias("n_reads"), F.bool_or("spanning").alias("any_spanning"), F.bool_and("exonic_only").alias("all_exonic"), F.flatten(seen).alias("seen"))
    sums = sums.withColumn("held", F.transform(F.filter("seen", lambda x: x["in"]), lambda x: x["t"]))
    every = F.forall("seen", lambda x: x["in"] | F.array_contains("held", x["t"]))
    kind = F.when(F.col("any_spanning"), "unspliced").when(F.col("all_exonic"), "spliced").when(every, "unspliced").otherwise("ambiguous")
    return sums.select(*ids, "n_reads", kind.alias("annotation"))


def molecule_fragments(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Unions of a molecule's segments, strand by strand. `segments`: keys, molecule, chrom, strand, start, end."""
    return merge_intervals(segments, [*keys, "molecule", "chrom", "strand"])


def gene_index(transcripts: DataFrame) -> DataFrame:
    """gene_id, gene_name and gene_idx, dense in the order of names (ids break ties). One row for each gene."""
    genes = transcripts.groupBy("gene_id").agg(F.min("gene_name").alias("gene_name"))
    return genes.withColumn("gene_idx", (F.row_number().over(Window.orderBy("gene_name", "gene_id")) - 1).cast("long"))


def count_layers(annotated: DataFrame, cell: str = "barcode", gene: str = "gene_idx") -> DataFrame:
    """(cell, gene, layer, value): molecules in all (layer "X"), spliced and unspliced; zeros are left out."""
    layers = F.explode(F.when(F.col("annotation") == "ambiguous", F.array(F.lit("X"))).otherwise(F.array(F.lit("X"), F.col("annotation")))).alias("layer")
    return annotated.select(cell, gene, layers).groupBy(cell, gene, "layer").agg(F.count("*").alias("value"))


def csr_rows(counts: DataFrame, cell: str = "barcode", gene: str = "gene_idx") -> DataFrame:
    """One sparse row for each cell: cols and vals in the order of genes. A row is as long as a cell has genes."""
    rows = counts.groupBy(cell).agg(F.array_sort(F.collect_list(F.struct(gene, "value"))).alias("x"))
    return rows.select(cell, F.transform("x", lambda r: r[gene]).alias("cols"), F.transform("x", lambda r: r["value"]).alias("vals"))


def indexed_rows(counts: DataFrame, cell: str = "barcode", gene: str = "gene_idx") -> DataFrame:
    """The rows of `csr_rows` with row_idx (from 0, in the order of cells) and ptr, the entries in the rows before. Cells are
    sorted by ranges; entries are summed within each range and over the ranges before it, of which there is a row each."""
    rows = csr_rows(counts, cell, gene)
    placed = materialized(materialized(rows).repartitionByRange(cell).sortWithinPartitions(cell).withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    inner = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    light = placed.select(cell, "_range", "_at", F.size("cols").cast("long").alias("_n"))
    sums = light.groupBy("_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"), F.sum("_n").alias("_entries"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_range", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_r"), F.coalesce(F.sum("_entries").over(earlier), F.lit(0)).alias("_e"))
    pointers = light.withColumn("_p", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(before, "_range")
    pointers = pointers.select("_at", (F.col("_at") - F.col("_first") + F.col("_r")).alias("row_idx"), (F.col("_p") + F.col("_e")).alias("ptr"))
    return placed.join(pointers, "_at").select("row_idx", "ptr", cell, "cols", "vals")


def csr_blocks(counts: DataFrame, cell: str = "barcode", gene: str = "gene_idx", entries: int = 1 << 20) -> DataFrame:
    """The sparse matrix of cells by genes in blocks of rows: first_row, cells, indptr (pointers into the whole matrix, one more
    than rows), indices and data. A block takes the rows whose first entry lies in its `entries`, so that it has these and
    the rest of one row at most; rows are never empty. Blocks in the order of first_row are the whole matrix."""
    rows = indexed_rows(counts, cell, gene).withColumn("_block", F.expr(f"ptr div {entries}"))
    x = F.array_sort(F.collect_list(F.struct("row_idx", "ptr", F.col(cell).alias("cell"), "cols", "vals")))
    grouped = rows.groupBy("_block").agg(x.alias("x"))
    last = F.element_at("x", -1)
    return grouped.select(
        F.get("x", F.lit(0))["row_idx"].alias("first_row"),
        F.col("x.cell").alias("cells"),
        F.concat(F.col("x.ptr"), F.array(last["ptr"] + F.size(last["cols"]))).alias("indptr"),
        F.flatten("x.cols").alias("indices"),
        F.flatten("x.vals").alias("data"),
    )
