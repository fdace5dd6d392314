"""Barcode histograms, whitelists, cell calling and error correction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import error_probability, expected_errors, revcomp
from .storage import materialized

#: Status of a corrected barcode.
OK, NO_MATCH, LOW_CONFIDENCE, TOO_MANY_ERRORS = "ok", "no_match", "low_confidence", "exceeds_expected_errors"
#: Dictionaries up to so many entries are sent to the reads.
BROADCAST_ENTRIES = 2_000_000


def barcode_histogram(reads: DataFrame, keys: list[str], barcode: str = "barcode", reverse: str | None = None) -> DataFrame:
    """(keys, barcode, n): how often each barcode was read; barcodes of reverse reads are turned round first. One shuffle
    after partial aggregation, so that a frequent barcode is one row for each task."""
    seq = F.col(barcode) if reverse is None else F.when(F.col(reverse), revcomp(barcode)).otherwise(F.col(barcode))
    return reads.where(F.col(barcode).isNotNull()).groupBy(*keys, seq.alias("barcode")).agg(F.count("*").alias("n"))


def plausible(barcode: Column | str) -> Column:
    """Without a whitelist a barcode counts if it has more than one base and only A, C, G, T."""
    return F.col(barcode).rlike("^[ACGT]{2,}$") if isinstance(barcode, str) else barcode.rlike("^[ACGT]{2,}$")


def whitelist_counts(histogram: DataFrame, onlist: DataFrame | None = None, threshold: int | None = None) -> DataFrame:
    """(barcode, n, listed): the onlist's barcodes with their counts (0 where unseen), or the plausible ones that reach
    `threshold`, and the others with listed = false, whose reads are mismatches."""
    if onlist is not None:
        known = onlist.select("barcode").distinct().withColumn("listed", F.lit(True))
        return histogram.join(known, "barcode", "full").select("barcode", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("listed", F.lit(False)).alias("listed"))
    good = plausible("barcode")
    if threshold is not None:
        good = good & (F.col("n") >= threshold)
    return histogram.select("barcode", "n", good.alias("listed"))


def whitelist_stats(counts: DataFrame) -> DataFrame:
    """One row: total reads, mismatches, frac_exact (0 if there are no reads) and n_seen (listed barcodes read)."""
    total, miss = F.sum("n"), F.sum(F.when(~F.col("listed"), F.col("n")).otherwise(0))
    out = counts.agg(F.coalesce(total, F.lit(0)).alias("total"), F.coalesce(miss, F.lit(0)).alias("mismatches"), F.count_if(F.col("listed") & (F.col("n") > 0)).alias("n_seen"))
    return out.withColumn("frac_exact", F.coalesce(F.lit(1.0) - F.try_divide(F.col("mismatches").cast("double"), F.col("total")), F.lit(0.0)))


def correct_exact(reads: DataFrame, counts: DataFrame, barcode: str = "barcode") -> DataFrame:
    """Adds corrected (the barcode itself if it is listed) and posterior (1 or 0)."""
    known = counts.select(F.col("barcode").alias("_known"))
    return reads.join(known, F.col(barcode) == F.col("_known"), "left").withColumn("corrected", F.col("_known")).withColumn("posterior", F.when(F.col("_known").isNotNull(), 1.0).otherwise(0.0)).drop("_known")


def _masks(text: Column, length: Column, distance: int) -> Column:
    """Array of struct(key, i, j): the text with one place left out, or with each two places where `distance` is 2 and it
    has two. Texts that differ in no more than these places share a key."""
    put = lambda t, i: F.concat(F.substr(t, F.lit(1), i - 1), F.lit("*"), F.substr(t, i + 1, F.length(t)))
    none = F.lit(None).cast("int")
    one = F.transform(F.sequence(F.lit(1), length), lambda i: F.struct(put(text, i).alias("key"), i.alias("i"), none.alias("j")))
    if distance == 1:
        return one
    pairs = lambda i: F.transform(F.sequence(i + 1, length), lambda j: F.struct(put(put(text, i), j).alias("key"), i.alias("i"), j.alias("j")))
    return F.when(length < 2, one).otherwise(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), pairs)))


def near_entries(queries: DataFrame, known: DataFrame, distance: int) -> DataFrame:
    """q, near: for every text of `queries` (q) the entries of `known` (cand, n) that differ from it in one place, or in up to
    two, by A, C, G or T: array of struct(ord, cand, n, p1, p2), in the order in which equally good ones are preferred: by
    first place and base, a single change before its second ones. Both sides are exploded into keys with places left out,
    16 for 16 bases (120 for two places) where their neighbours would be 48 (about 1,100), and meet by equality."""
    by_key = known.where(F.length("cand") > 0).select("cand", "n", F.explode(_masks(F.col("cand"), F.length("cand"), distance)).alias("x")).select("cand", "n", F.col("x.key").alias("key"))
    asked = queries.where(F.length("q") > 0).select("q", F.explode(_masks(F.col("q"), F.length("q"), distance)).alias("x")).select("q", "x.*")
    met = asked.join(by_key, "key")
    base = lambda c, i: F.substr(F.col(c), F.col(i), F.lit(1))
    differs = lambda i: base("q", i) != base("cand", i)
    # A pair that differs in one place shares all keys that leave it out; the one with the first other place counts.
    at_i = differs("i") & (F.col("j").isNull() | (~differs("j") & (F.col("i") == 1) & (F.col("j") == 2)))
    at_j = F.col("j").isNotNull() & differs("j") & ~differs("i") & (F.col("i") == 1)
    both = F.col("j").isNotNull() & differs("i") & differs("j")
    p1 = F.when(at_j, F.col("j")).otherwise(F.col("i"))
    placed = met.where(at_i | at_j | both).withColumns({"p1": p1, "p2": F.when(both, F.col("j"))})
    bases = F.array(*map(F.lit, "ACGT"))
    rank = lambda p: F.array_position(bases, base("cand", p))
    order = (F.col("p1").cast("long") * 5 + rank("p1")) * 1_000_000 + F.coalesce(F.col("p2") * 5 + rank("p2"), F.lit(0))
    kept = placed.where((rank("p1") > 0) & (F.col("p2").isNull() | (rank("p2") > 0)))
    return kept.groupBy("q").agg(F.array_sort(F.collect_list(F.struct(order.alias("ord"), "cand", "n", "p1", "p2"))).alias("near"))


def correct_barcodes(reads: DataFrame, counts: DataFrame, read_id: list[str], barcode: str = "barcode", qual: str = "qual", distance: int = 1, threshold: float = 0.975, max_expected_errors: float | None = None) -> DataFrame:
    """Adds corrected, posterior and status to reads, by an error-tolerant join with a dictionary.

    `counts`: barcode, n (0 for listed but unseen ones). A listed barcode stands for itself with posterior 1. Otherwise
    every listed barcode within `distance` changes weighs (1 + n) times the error probabilities of the changed qualities
    (capped at 66), and the heaviest is taken if its share reaches `threshold`. Each distinct unknown barcode is met once
    with the dictionary (near_entries), the entries near it are written as one row, and reads take that row: they are neither
    exploded nor grouped, and not shuffled at all where dictionary and rows are small enough to be sent. Beyond that only
    reads with unknown barcodes are shuffled, by barcode; very frequent ones are split by the join. `read_id` is kept for
    callers and not used.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    known = materialized(counts.select(F.col("barcode").alias("cand"), F.col("n").cast("long").alias("n")))
    sent = F.broadcast(known) if known.count() <= BROADCAST_ENTRIES else known
    marked = reads.join(sent.select(F.col("cand").alias(barcode), F.lit(True).alias("_listed")), barcode, "left")
    errors = F.lit(False) if max_expected_errors is None else F.coalesce(expected_errors(qual) >= max_expected_errors, F.lit(False))
    marked = marked.withColumn("_late", errors)
    open_ = F.col("_listed").isNull() & ~F.col("_late") & F.col(barcode).isNotNull()
    near = materialized(near_entries(marked.where(open_).select(F.col(barcode).alias("q")).distinct(), known, distance))
    if (near.agg(F.sum(F.size("near"))).first()[0] or 0) <= BROADCAST_ENTRIES:
        met = marked.join(F.broadcast(near), F.when(open_, F.col(barcode)) == F.col("q"), "left")
    else:
        rest = marked.where(open_).join(near, F.col(barcode) == F.col("q"), "left")
        met = marked.where(~open_).withColumns({"q": F.lit(None).cast("string"), "near": F.lit(None).cast(near.schema["near"].dataType)}).unionByName(rest)
    capped = lambda p: error_probability(F.least(F.ascii(F.substr(F.col(qual), p, F.lit(1))), F.lit(66)))
    weight = lambda x: (1 + x["n"]) * capped(x["p1"]) * F.when(x["p2"].isNull(), 1.0).otherwise(capped(x["p2"]))
    weighed = F.transform("near", lambda x: F.struct(weight(x).alias("w"), (-x["ord"]).alias("o"), x["cand"].alias("cand")))
    best, total = F.array_max("_near"), F.aggregate("_near", F.lit(0.0), lambda s, x: s + x["w"])
    out = met.withColumn("_near", weighed).withColumns({"_cand": best["cand"], "_share": F.try_divide(best["w"], total)})
    status = (
        F.when(F.col(barcode).isNull(), NO_MATCH)
        .when(F.col("_late"), TOO_MANY_ERRORS)
        .when(F.col("_listed"), OK)
        .when(F.col("_share").isNull(), NO_MATCH)
        .when(F.col("_share") >= threshold, OK)
        .otherwise(LOW_CONFIDENCE)
    )
    out = out.withColumn("status", status).withColumn("posterior", F.when(F.col("_late"), None).when(F.col("_listed"), 1.0).otherwise(F.coalesce("_share", F.lit(0.0))))
    return out.withColumn("corrected", F.when(F.col("status") == OK, F.when(F.col("_listed"), F.col(barcode)).otherwise(F.col("_cand")))).drop("_listed", "_late", "_cand", "_share", "_near", "q", "near")


def join_parts(*corrected: str) -> Column:
    """A barcode of several regions; null if any region could not be corrected."""
    return F.concat(*corrected)


def within_ordmag(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """For each baseline rank idx (0: the largest count): how many counts reach a tenth of that count, at least 1.
    `counts`: n; `ranks`: idx and any other columns. A histogram of counts is what the two are joined on, which has as
    many rows as there are different counts."""
    sizes = counts.where("n > 0").groupBy("n").agg(F.count("*").alias("m"))
    down = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tall = sizes.select("n", "m", F.sum("m").over(down).alias("upto"))
    base = ranks.join(tall.select(F.col("n").alias("base"), (F.col("upto") - F.col("m")).alias("a"), F.col("upto").alias("b")), (F.col("idx") >= F.col("a")) & (F.col("idx") < F.col("b")))
    base = base.withColumn("cutoff", F.greatest(F.round(F.lit(0.1) * F.col("base")), F.lit(1.0)))
    keys = ranks.columns
    return base.join(tall, F.col("n") >= F.col("cutoff")).groupBy(*keys, "cutoff").agg(F.sum("m").alias("within"))


def ordmag_threshold(counts: DataFrame) -> DataFrame:
    """One row: recovered, top_n and threshold, by the order-of-magnitude rule with the counts as their only sample.

    Among 2 ** 0 .. 2 ** 17, `recovered` is the x with the smallest (within(x / 100) - x) ** 2 / x, the first of equals;
    top_n barcodes lie within its order of magnitude, and the threshold is the first count below them (the smallest count
    if all are above). An empty table gives no row.
    """
    spark = counts.sparkSession
    n = counts.where("n > 0").select(F.count("*").alias("total"))
    xs = spark.range(18).select(F.pow(F.lit(2.0), F.col("id")).alias("x")).join(F.broadcast(n)).where("total > 0")
    tries = xs.select("x", "total", F.least(F.round(F.lit(0.01) * F.col("x")), F.col("total") - 1).cast("long").alias("idx"))
    loss = within_ordmag(counts, tries).withColumn("loss", F.pow(F.col("within") - F.col("x"), F.lit(2.0)) / F.col("x"))
    best = loss.groupBy("total").agg(F.min(F.struct("loss", "x")).alias("m")).select("total", F.col("m.x").alias("recovered"))
    again = best.select("total", "recovered", F.least(F.round(F.lit(0.01) * F.col("recovered")), F.col("total") - 1).cast("long").alias("idx"))
    top = within_ordmag(counts, again).select("total", "recovered", F.col("within").alias("top_n"))
    sizes = counts.where("n > 0").groupBy("n").agg(F.count("*").alias("m"))
    tall = sizes.select("n", F.sum("m").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"))
    at = F.least(F.col("top_n"), F.col("total") - 1)  # rank from the top of the first count below
    return top.join(tall, F.col("upto") > at).groupBy("recovered", "top_n").agg(F.max("n").alias("threshold")).select(F.col("recovered").cast("long").alias("recovered"), F.col("top_n").cast("long").alias("top_n"), F.col("threshold").cast("long").alias("threshold"))


def ordmag_bootstrap(counts: DataFrame, samples: int = 1000, seed: int = 0) -> dict[str, int]:
    """The same with bootstrap averages and a fixed seed. Samples are drawn as multinomial counts over the distinct count
    values, whose number does not follow the number of barcodes; they are what the driver sees."""
    sizes = sorted((r["n"], r["m"]) for r in counts.where("n > 0").groupBy("n").agg(F.count("*").alias("m")).collect())
    if not sizes:
        return {"recovered": 0, "top_n": 0, "threshold": 0}
    value, many = np.array([a for a, _ in sizes], float), np.array([b for _, b in sizes], float)
    total, rng = int(many.sum()), np.random.default_rng(seed)

    def within(m: np.ndarray, idx: int) -> float:
        above = np.cumsum(m[::-1])[::-1]
        base = value[np.flatnonzero(above > idx)[-1]]
        return float(m[value >= max(round(0.1 * base), 1)].sum())

    def recovered(m: np.ndarray) -> float:
        xs = [2.0**k for k in range(18)]
        return min(xs, key=lambda x: (within(m, min(round(0.01 * x), total - 1)) - x) ** 2 / x)

    draw = lambda: rng.multinomial(total, many / total).astype(float)
    average = np.mean([recovered(draw()) for _ in range(samples)])
    idx = min(round(0.01 * average), total - 1)
    top = round(float(np.mean([within(draw(), idx) for _ in range(samples)])))
    above = np.cumsum(many[::-1])[::-1]
    return {"recovered": round(float(average)), "top_n": top, "threshold": int(value[np.flatnonzero(above > min(top, total - 1))[-1]])}


def knee_point(counts: DataFrame, most: int = 10_000) -> DataFrame:
    """One row (rank, n): where the log-log rank curve of the first `most` counts bends most (second difference)."""
    top = counts.where("n > 0").select("n", "barcode").orderBy(F.desc("n"), "barcode").limit(most)
    w = Window.orderBy(F.desc("n"), "barcode")
    ranked = top.select("n", F.row_number().over(w).alias("rank")).select("rank", "n", F.log(F.col("rank").cast("double")).alias("x"), F.log(F.col("n").cast("double")).alias("y"))
    o = Window.orderBy("rank")
    slope = ranked.withColumn("s", (F.lead("y").over(o) - F.col("y")) / (F.lead("x").over(o) - F.col("x")))
    bend = slope.withColumn("d", F.abs(F.lead("s").over(o) - F.col("s"))).where("d is not null")
    return bend.agg(F.max(F.struct(F.round("d", 9).alias("d"), (-F.col("rank")).alias("r"), "n")).alias("m")).select((-F.col("m.r")).cast("long").alias("rank"), F.col("m.n").alias("n"))


def onlist_product(*onlists: DataFrame) -> DataFrame:
    """All concatenations of the regions' barcodes, in the order of regions. The product is the result that is asked for;
    onlists are distinct lists of barcodes."""
    out = onlists[0].select("barcode").distinct()
    for x in onlists[1:]:
        out = out.select(F.col("barcode").alias("_b")).join(x.select("barcode").distinct()).select(F.concat("_b", "barcode").alias("barcode"))
    return out


def unique_barcode(number: Column | str, total: int) -> Column:
    """The number-th of `total` different barcodes of the least sufficient length."""
    from ..functions.seq import base4

    length = 1
    while 4**length < total:
        length += 1
    return base4(number, length)
