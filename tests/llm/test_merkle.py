"""The Merkle manifest against a plain version."""

import hashlib
import zlib
from collections import defaultdict

from helixgrid.llm.merkle import merkle_manifest
from helixgrid.llm.ranks import with_ranks

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(digests):
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, path in enumerate(paths):
            j = at[i]
            run = level[j // 3 * 3 : j // 3 * 3 + 3]
            path.append(("".join(run[: j % 3]), "".join(run[j % 3 + 1 :])))
            at[i] = j // 3
        level = [digest("".join(level[a : a + 3])) for a in range(0, len(level), 3)]
    return level[0], paths


def plain(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for row in rows:
        i, source, lang, n, text = row
        even = text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        changed = (i, source, lang, n, text.replace("\n", "") if even else text)
        groups[source].append((i is not None, i or 0, digest("".join(map(field, row))), digest("".join(map(field, changed))), i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    sub = {}
    for s in names:
        groups[s].sort()
        sub[s] = tree([x[2] for x in groups[s]])
    root, up = tree([sub[s][0] for s in names])
    out = []
    for s, above in zip(names, up, strict=True):
        for x, below in zip(groups[s], sub[s][1], strict=True):
            path, h = below + above, x[3]
            for before, after in path:
                h = digest(before + h + after)
            out.append((x[4], x[2], sub[s][0], root, digest("".join(a + b for a, b in path)), h, h == root))
    return sorted(map(str, out))


def frame(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, rank int")
    return df.repartition(5)


def found(df):
    return sorted(str(tuple(r)) for r in merkle_manifest(df).collect())


def test_hot_groups_nulls_repeats_and_long_texts(spark):
    rows = [(i, "hot" if i % 3 else (None if i % 2 else "é"), "x", i, f"a\n{i}") for i in range(1200)]
    rows += [(5, "hot", "x", 5, "a\n5")] * 3 + [(None, "hot", None, None, None)] * 2 + [(9999, "", None, None, "\n"), (7, "Z", "x", 0, ""), (8, "z", "x", 0, "é\n" * 500_000)]
    assert found(frame(spark, rows)) == plain(rows)


def test_sizes_around_powers_of_three(spark):
    for n in (3, 82):
        rows = [(i, "s", None, i, str(i)) for i in range(n)]
        assert found(frame(spark, rows)) == plain(rows), n


def test_many_groups(spark):
    rows = [(i, f"g{i % 97}", "x", 1, "t\n") for i in range(100)]
    assert found(frame(spark, rows)) == plain(rows)


def test_only_tampered_rows_fail(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*FIELDS).collect()]
    got = merkle_manifest(docs).collect()
    tampered = {r[0] for r in rows if r[4] and "\n" in r[4] and zlib.crc32(str(r[0]).encode()) % 2 == 0}
    assert {r.doc_id for r in got if not r.verified} == tampered
    assert len({r.root for r in got}) == 1 and len(got) == len(rows)


def test_empty_table(spark):
    assert found(frame(spark, [(1, "s", "x", 1, "t")]).limit(0)) == []


def test_ranks_of_a_group_over_many_ranges(spark):
    df = spark.createDataFrame([(i % 2 or None, i // 3, i) for i in range(1000)], "g int, v int, row int").repartition(7)
    rows = sorted(((r.g is not None, r.g or 0, r.v, r.row), r["rank"]) for r in with_ranks(df, ["v", "row"], "g").collect())
    counts = defaultdict(int)
    for key, rank in rows:
        assert rank == counts[key[:2]]
        counts[key[:2]] += 1
