"""How many rows steps of the reads' way to genes make, and which steps their plans have."""

from pyspark.sql import functions as F

from helixgrid.operators import intervals as I
from helixgrid.operators import transcriptome as T


def _generated(plan):
    own = [plan.metrics().apply("numOutputRows").value()] if plan.nodeName() == "Generate" else []
    return own + [n for i in range(plan.children().size()) for n in _generated(plan.children().apply(i))]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_intervals_visit_the_bins_that_they_touch_alone(spark):
    left = spark.range(1000).select(F.lit("a").alias("chrom"), (F.col("id") * 16).alias("start"), (F.col("id") * 16 + 16).alias("end"))
    right = spark.range(100).select(F.lit("a").alias("chrom"), (F.col("id") * 160).alias("start"), (F.col("id") * 160 + 32).alias("end"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = I.overlap_join(left, right, 64)
        rows = met.collect()
        assert len(rows) == 200
        assert sorted(_generated(met._jdf.queryExecution().executedPlan()))[-1] == 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_molecules_are_annotated_and_umis_met_without_joins(spark):
    hits = "array<struct<transcript_id:string,align_type:string>>"
    rows = [("c", "g", "m", [("t1", "exonic"), ("t2", "intronic")], False, False), ("c", "g", "m", [("t1", "spanning")], False, False), ("c", "g", "o", [("t1", "exonic"), ("t2", "intronic")], False, False), ("c", "g", "e", [], False, False)]
    out = T.annotate_molecules(spark.createDataFrame(rows, f"c string, g string, molecule string, hits {hits}, exonic_only boolean, spanning boolean"), ["c", "g"])
    assert "Join" not in _plan(out)
    assert {r.molecule: (r.n_reads, r.annotation) for r in out.collect()} == {"m": (2, "unspliced"), "o": (1, "ambiguous"), "e": (1, "unspliced")}
    to = T.umi_targets(spark.createDataFrame([("c", "AC"), ("c", "AC"), ("c", "AT"), ("c", ""), ("c", None)], "c string, umi string"), ["c"])
    assert "Join" not in _plan(to)
    assert {r.umi: (r.n, r.target) for r in to.collect()} == {"AC": (2, "AC"), "AT": (1, "AC"), "": (1, "")}


def test_rows_of_reads_keep_their_tags(spark):
    reads = spark.createDataFrame([(1, 0, "x"), (1, 0, "y"), (2, 0, "z")], "read_id long, aln_idx int, tag string")
    hits = spark.createDataFrame([(1, 0, "t", "g", "exonic", False)], "read_id long, aln_idx int, transcript_id string, gene_id string, align_type string, antisense boolean")
    out = T.resolve_single(reads, hits, ["tag"])
    assert sorted((r.read_id, r.tag, r.kind, r.gene_id) for r in out.collect()) == [(1, "x", "aligned", "g"), (1, "y", "aligned", "g"), (2, "z", "intergenic", None)]
