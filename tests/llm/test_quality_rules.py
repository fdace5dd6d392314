"""The learner of decision lists against plain sequential covering, and odd rows of the rules."""

import math
import random

from pyspark.sql import functions as F

from helixgrid.llm import quality


def _quantile(values, p):
    values = sorted(values)
    return values[max(math.ceil(p * len(values)), 1) - 1]


def _plain(rows, steps=12, most_rules=8, most_conditions=3, least=8, precision=0.8):
    """rows: (features, y, held). The same search over lists of rows, a row at a time."""
    kinds = list(rows[0][0])
    cuts = {}
    for k in kinds:
        marks = sorted({_quantile([f[k] for f, y, _ in rows if y == c], i / (steps + 1)) for c in (0, 1) for i in range(1, steps + 1)})
        cuts[k] = [(a + b) / 2 for a, b in zip(marks, marks[1:], strict=False)]
    met = lambda rule, f: all(f[k] <= t if op == "<=" else f[k] > t for k, op, t in rule)
    count = lambda part, rule: tuple(sum(y == c and met(rule, f) for f, y, _ in part) for c in (0, 1))
    rules = []
    while len(rules) < most_rules:
        left = [r for r in rows if not any(met(x, r[0]) for x in rules)]
        grow, held = [r for r in left if not r[2]], [r for r in left if r[2]]
        rule = []
        while len(rule) < most_conditions:
            p0, n0 = count(grow, rule)
            if p0 < least or not n0:
                break
            best = (0.0, None)
            for k in kinds:
                for t in cuts[k]:
                    for op in ("<=", ">"):
                        p, n = count(grow, [*rule, (k, op, t)])
                        if p >= least:
                            g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if g > best[0] + 1e-9:
                                best = (g, (k, op, t))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        prefixes = [rule[:i] for i in range(1, len(rule) + 1)]
        worth = [count(held, x) for x in prefixes]
        score = [(p - n) / max(1, p + n) for p, n in worth]
        i = score.index(max(score))
        (hp, hn), (gp, gn) = worth[i], count(grow, prefixes[i])
        if hp < precision * (hp + hn) or gp < precision * (gp + gn) or gp < least or not hp + hn:
            break
        rules.append(prefixes[i])
    return rules


def test_learn_against_plain_covering(spark):
    rng = random.Random(41)
    rows = []
    for i in range(700):
        words = rng.randint(10, 400)
        bad = i % 3 == 0
        kind = rng.randrange(3) if bad else None
        rows.append((i, words, words * rng.randint(3, 9), rng.randint(0, 4) + (40 if kind == 0 else 0), rng.randint(0, 2) + (12 if kind == 1 else 0), rng.randint(0, words // 8), 20, rng.randint(0, 3) + (words // 3 if kind == 2 and words > 100 else 0), int(not bad)))
    counts = spark.createDataFrame(rows, "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_bangs long, quality int")
    got = quality.learn(counts.drop("quality"), counts.select("id", "quality"))
    seen = counts.select("quality", (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("held"), *(c.alias(k) for k, c in quality.features().items())).collect()
    want = _plain([({k: float(r[k]) for k in quality.features()}, r.quality, r.held) for r in seen])
    assert [[c[:2] for c in rule] for rule in got] == [[c[:2] for c in rule] for rule in want] and len(got) >= 2
    assert all(abs(a[2] - b[2]) < 1e-9 for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_repeated_rows_and_long_texts(spark):
    long = "word and words " * 100_000
    rows = [(1, long), (1, long), (2, "one two three four five six seven eight nine ten eleven"), (3, "#" * 1_000_000), (4, None)]
    docs = spark.createDataFrame([(i, t, 5, True) for i, t in rows], "doc_id long, text string, n_words int, kept boolean")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "doc_id long, quality int")
    got = sorted((r.doc_id, r.n_words, r.n_symbols, r.base_failed, r.kept) for r in quality.quality_rules(docs, labels).collect())
    assert got == [(1, 300_000, 0, True, False), (1, 300_000, 0, True, False), (2, 11, 0, False, True), (3, 1, 1_000_000, True, False), (4, 0, 0, True, False)]
