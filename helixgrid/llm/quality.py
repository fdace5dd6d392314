"""Quality rules: fixed base rules, then a learned decision list, all as native Spark expressions.

The list is learned by sequential covering: a rule is a conjunction of thresholds, grown by information gain on two
thirds of the labelled rows and pruned from its end on the other third; rows that it covers are set aside for the next
rule. Every step is a small aggregate over binned counts of the labelled rows, of which the driver sees at most one
row for each feature and bin. The result is an ordered F.when chain.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import written

#: Words are runs of anything else.
WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of a window whose repetition counts.
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with `value` evaluated once, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeated(words: Column, n: Column) -> Column:
    """Words within windows of WINDOW words that occur twice or more in the text, first occurrences included."""

    def covered(windows: Column) -> Column:
        def places(s: Column) -> Column:
            at = lambda i: F.get(s, i)["h"]
            same = lambda i: F.coalesce(at(i) == at(i - 1), F.lit(False)) | F.coalesce(at(i) == at(i + 1), F.lit(False))
            found = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), same), lambda i: F.get(s, i)["i"]))
            return _let(found, lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda a, i: a + F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(WINDOW)))))

        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(ordered, places))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(_let(hashes, lambda h: _let(windows(h), covered)))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and COUNTS of every whole text; a null text counts as an empty one. No shuffle and no Python."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, WHITE), "")
    lines = F.split(text, "\n")
    full = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("c"), _repeated(w, F.size(w)).alias("r")),
    )
    of_lines = _let(full, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    read = docs.select(F.col(id_col).cast("long").alias("id"), of_words.alias("w"), of_lines.alias("l"), (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("s"), (F.char_length(text) - F.char_length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("b"))
    return read.select("id", F.col("w.n").alias("n_words"), F.col("w.c").alias("word_chars"), F.col("s").alias("n_symbols"), F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), F.col("b").alias("n_bangs"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What rules put thresholds on: shares and means, so that they do not follow the length of a text."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols_per_char": per("n_symbols", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "mean_word": per("word_chars", "n_words"),
        "bangs_per_word": per("n_bangs", "n_words"),
        "words": F.col("n_words").cast("double"),
    }


def _gain(p: float, n: float, all_p: float, all_n: float) -> float:
    if p <= 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(all_p / (all_p + all_n)))


def learn(counts: DataFrame, labels: DataFrame, label_col: str = "quality", steps: int = 12, most_rules: int = 8, most_conditions: int = 3, least_rows: int = 8, precision: float = 0.8) -> list[list[tuple[str, str, float]]]:
    """Ordered rules, each a conjunction of (feature, "<=" or ">", threshold), that mark rows of label 0.

    `counts`: id and COUNTS of rows that passed the base rules; `labels`: id and a 0/1 column (an id labelled twice is
    0 if any label is; null labels are left out). Thresholds lie midway between quantiles of both classes over all
    labelled rows; a rule must cover `least_rows` rows of label 0 and be right for the share `precision` of the held third.
    No labels, or labels of one class only, give no rules.
    """
    said = labels.select(F.col("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    kinds = features()
    rows = written(counts.join(said, "id").select("y", (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("held"), *(c.alias(k) for k, c in kinds.items())), "labelled")
    grid = [i / (steps + 1) for i in range(1, steps + 1)]
    found = rows.groupBy("y").agg(*(F.percentile_approx(k, F.array(*map(F.lit, grid)), 1000).alias(k) for k in kinds)).collect()
    if len(found) < 2:
        return []
    marks = {k: sorted({x for r in found for x in r[k]}) for k in kinds}
    cuts = {k: [(a + b) / 2 for a, b in zip(v, v[1:])] for k, v in marks.items()}  # noqa: B905
    bins = [sum((F.when(F.col(k) > t, 1).otherwise(0) for t in cuts[k]), F.lit(0)).alias(k) for k in kinds]
    cells = written(rows.select("y", "held", *bins).groupBy("y", "held", *kinds).agg(F.count("*").alias("c")), "cells")

    def met(rule: list[tuple[str, str, int]]) -> Column:
        out = F.lit(True)
        for k, op, b in rule:
            out = out & (F.col(k) <= b if op == "<=" else F.col(k) > b)
        return out

    rules: list[list[tuple[str, str, int]]] = []
    for _ in range(most_rules):
        left = cells.where(~met(rules[0])) if rules else cells
        for r in rules[1:]:
            left = left.where(~met(r))
        rule: list[tuple[str, str, int]] = []
        while len(rule) < most_conditions:
            pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("b")) for k in kinds))).alias("f")
            seen = left.where(~F.col("held")).where(met(rule)).select("y", "c", pairs).groupBy("f.k", "f.b").agg(F.sum(F.when(F.col("y") == 0, F.col("c")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 1, F.col("c")).otherwise(0)).alias("n")).collect()
            first = [r for r in seen if r["k"] == next(iter(kinds))]
            all_p, all_n = sum(r["p"] for r in first), sum(r["n"] for r in first)
            if all_p < least_rows or all_n == 0:
                break
            best: tuple = (0.0, None)
            for k in kinds:
                of = {r["b"]: (r["p"], r["n"]) for r in seen if r["k"] == k}
                p = n = 0
                for b in range(len(cuts[k])):
                    p, n = p + of.get(b, (0, 0))[0], n + of.get(b, (0, 0))[1]
                    for op, x, y in (("<=", p, n), (">", all_p - p, all_n - n)):
                        if x >= least_rows and (g := _gain(x, y, all_p, all_n)) > best[0] + 1e-9:
                            best = (g, (k, op, b))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        # Prune: the prefix of conditions that is best on the held third.
        prefixes = [rule[:i] for i in range(1, len(rule) + 1)]
        sums = [F.sum(F.when(met(x) & (F.col("y") == y), F.col("c")).otherwise(0)).alias(f"s{i}_{y}") for i, x in enumerate(prefixes) for y in (0, 1)]
        held, grown = left.where("held").agg(*sums).first(), left.where("not held").agg(*sums).first()
        worth = lambda r, i: ((r[f"s{i}_0"] or 0), (r[f"s{i}_1"] or 0))
        score = [(p - n) / max(1, p + n) for p, n in (worth(held, i) for i in range(len(prefixes)))]
        i = max(range(len(prefixes)), key=lambda i: (score[i], -i))
        (hp, hn), (gp, gn) = worth(held, i), worth(grown, i)
        if hp < precision * (hp + hn) or gp < precision * (gp + gn) or gp < least_rows or hp + hn == 0:
            break
        rules.append(prefixes[i])
    return [[(k, op, float(cuts[k][b])) for k, op, b in rule] for rule in rules]


def verdict(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The ordered conditional expression of a decision list: false for the first rule that applies, else true."""
    kinds = features()
    out: Column | None = None
    for rule in rules:
        met = F.lit(True)
        for k, op, t in rule:
            met = met & (kinds[k] <= t if op == "<=" else kinds[k] > t)
        out = F.when(met, F.lit(False)) if out is None else out.when(met, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept, a row for each row.

    kept is false where a base rule fails (fewer than 10 words, or over a fifth of the words in repeated windows), else
    the verdict of a decision list learned from `labels`. Null, empty and white texts have no words and fail; null ids
    stay and are never matched with labels; a repeated row is judged as often as it stands; other columns, whatever
    their names, are not read. Empty documents give an empty result, empty labels an empty list of rules.
    """
    counts = written(text_counts(docs, id_col, text_col), "counts")
    rules = learn(counts.where(~base_failed()), labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col)), label_col)
    return counts.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
