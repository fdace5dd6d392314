"""Target-distribution importance resampling: array-scored weights, Gumbel scores and a distributed quickselect.

Hashed n-grams of the corpus and of the target are counted once; the gain of each bucket becomes one array, by which every
document is scored where it lies. The k-th highest score is then found without sorting: rows propose random pivots, one
pass counts the rows before and at every pivot exactly, and only the stretch that holds the k-th key is looked at again.
The winners alone are sorted and ranked.
"""

from __future__ import annotations

from math import floor, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import written
from .ranks import with_ranks

#: Characters that are no part of a word, once A-Z are lower-cased: ASCII but digits and letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pivots of a pass.
PIVOTS = 15
#: What orders rows: the score downwards, the id, then what tells rows of one id apart.
KEY = ("_score", "_late", "_id", "n_features", "_row")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def features_of(text: Column, longest: int) -> Column:
    """Runs of 1 to `longest` consecutive words, joined by a space, repeats kept."""
    words = words_of(text)
    if longest == 1:
        return words

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(*[F.when(F.size(words) >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)])


def bucket_of(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(docs: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """Numbers of features by bucket, summed within tasks before they are shuffled."""
    return docs.select(F.explode(features_of(F.col(text_col), longest)).alias("f")).groupBy(bucket_of(F.col("f"), buckets).alias("bucket")).count()


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> list[int]:
    """floor(1000 ln) of the ratio of a bucket's smoothed shares in target and corpus, for every bucket."""
    both = bucket_counts(docs, text_col, longest, buckets).select("bucket", F.col("count").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(bucket_counts(target, target_text_col, longest, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("count").alias("t")))
    # At most `buckets` rows, a parameter.
    found = {r.bucket: (r.s, r.t) for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()}
    all_s, all_t = (sum(x[i] for x in found.values()) for i in (0, 1))
    counts = [found.get(b, (0, 0)) for b in range(buckets)]
    return [floor(1000 * log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))) for s, t in counts]


def _keyed(scored: DataFrame) -> DataFrame:
    return scored.withColumns({"_score": -F.col("score"), "_late": F.col("id").isNull(), "_id": F.coalesce("id", F.lit(0))})


def _before(key: tuple) -> str:
    """SQL for rows whose key is smaller than `key`, of numbers and truth values."""
    out = "false"
    for name, value in reversed(list(zip(KEY, key, strict=True))):
        out = f"({name} < {value} or {name} = {value} and {out})"
    return out


def kth_key(rows: DataFrame, k: int, seed: int = 0) -> tuple:
    """The k-th smallest key (from 1) of rows, which no two rows share and of which there are k at least. A pass over the
    rows still in question counts, for each of PIVOTS random keys of theirs, the rows before it and at it; expected passes are the
    logarithm of the rows to the base PIVOTS. Only pivots and counts come to the driver."""
    low = high = None
    passes = 0
    while True:
        open_rows = rows
        if low is not None:  # the score alone first: it is what files can skip by
            open_rows = open_rows.where(f"_score >= {low[0]} and not {_before(low)} and _row <> {low[-1]}")
        if high is not None:
            open_rows = open_rows.where(f"_score <= {high[0]} and {_before(high)}")
        drawn = open_rows.orderBy(F.xxhash64("_row", F.lit(seed + passes)), "_row").limit(PIVOTS).select(*KEY).collect()
        pivots = sorted(tuple(r) for r in drawn)
        # Place of a row among the pivots: 2 i between pivots i - 1 and i, 2 i + 1 at pivot i.
        place = " + ".join(f"case when {_before(p)} then 0 when _row = {p[-1]} then 1 else 2 end" for p in pivots)
        found = dict(open_rows.groupBy(F.expr(place).alias("place")).count().collect())
        passes += 1
        below = [sum(found.get(j, 0) for j in range(i)) for i in range(2 * len(pivots) + 1)]
        before, at = below[1::2], [found.get(2 * i + 1, 0) for i in range(len(pivots))]
        inside = [i for i in range(len(pivots)) if before[i] < k <= before[i] + at[i]]
        if inside:
            return pivots[inside[0]]
        left = [i for i in range(len(pivots)) if before[i] + at[i] < k]
        right = [i for i in range(len(pivots)) if before[i] >= k]
        if right:
            high = pivots[right[0]]
        if left:
            low, k = pivots[left[-1]], k - before[left[-1]] - at[left[-1]]


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    longest: int = 1,
    buckets: int = 10_000,
    seed: str = "2024",
    least_words: int = 20,
    percent: int = 10,
) -> DataFrame:
    """Weights of documents under the target's distribution, and the `percent` of them that a weighted draw without
    replacement takes (Gumbel scores, the highest first).

    Returns id, n_features, weight, score and rank (1, 2, ... of those drawn, else null), a row for each row. A null or empty
    text has no features, weight 0 and is not eligible below `least_words`. A null id draws by the empty string and stands
    behind all ids of its score; repeated rows are documents of their own, with one score, and rank one after another; rows of
    one id and score rank by n_features. An empty table gives none; an empty target is smoothed to equal shares. Texts are read
    whole; columns with clashing names are not read.
    """
    gains = bucket_gains(docs, target, text_col, target_text_col, longest, buckets)
    # One constant of `buckets` numbers; the plan holds it once, and rows look buckets up by place.
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    read = docs.select(F.col(id_col).cast("long").alias("id"), features_of(F.col(text_col), longest).alias("f"), F.size(words_of(F.col(text_col))).alias("n_words"))
    total = F.aggregate("f", F.lit(0).cast("long"), lambda sum_, x: sum_ + F.get(table, bucket_of(x, buckets)))
    summed = read.select("id", F.size("f").cast("long").alias("n_features"), "n_words", total.alias("sum"), F.monotonically_increasing_id().alias("_row"))
    weight = F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(summed.withColumn("weight", weight).withColumn("score", F.col("weight") + luck).drop("sum"), "scored")
    eligible = _keyed(scored.where(F.col("n_words") >= least_words))
    k = eligible.count() * percent // 100
    if k == 0:
        return scored.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    last = kth_key(eligible, k)
    won = eligible.withColumn("_won", F.expr(f"{_before(last)} or _row = {last[-1]}")).where("_won")
    won = written(won.select(F.col("_score").alias("s"), F.col("_late").alias("l"), F.col("_id").alias("i"), "n_features", F.col("_row").alias("row"), "id", "weight", "score"), "winners")
    ranked = with_ranks(won, ["s", "l", "i", "n_features", "row"]).select("row", (F.col("rank") + 1).alias("rank"))
    joined = scored.join(ranked, F.col("_row") == F.col("row"), "left")
    return joined.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
