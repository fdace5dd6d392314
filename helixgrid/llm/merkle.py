"""A Merkle manifest of a dataset, its nodes labelled with nested intervals of leaf ranks.

Leaves stand in the order of their ids within a group; a node covers the interval of ranks of the leaves below it. Levels are
built in bands of four: the up to 81 entries of a band under one node meet in one row, which holds all nodes of the band with
their intervals and children. Going down, an entry is joined with the row of its bucket; the nodes whose interval contains
its own are its ancestors, and the children of an ancestor outside of its interval are its siblings there. So a level costs no
shuffle of its own, a key never has more than 81 entries, and a group of any size is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import written
from .ranks import with_ranks

#: Nodes in a run.
FAN = 3
#: Levels in a band, and the entries that meet in one of its rows.
BAND = 4
WIDTH = FAN**BAND
#: Powers of FAN that a rank of 63 bits can meet.
POWERS = [FAN**i for i in range(40)]
#: Schema of the path of a node: at each level the digests before and after it in its run.
PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A value as it is hashed: `-` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def _runs(nodes: Column) -> Column:
    """Parents of nodes in order: the interval, the digest and the children of each."""

    def parent(i: Column) -> Column:
        kids = F.slice(nodes, i * FAN + 1, FAN)
        return F.struct(F.get(kids, F.lit(0))["lo"].alias("lo"), F.element_at(kids, -1)["hi"].alias("hi"), digest(F.array_join(kids["digest"], "")).alias("digest"), kids.alias("kids"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")), parent)


def _plain(nodes: Column) -> Column:
    return F.transform(nodes, lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest")))


def _climb(entries: DataFrame, band: int) -> DataFrame:
    """A row for each bucket of a band: tree, depth, bucket, top (its last node), nodes (all above the entries)."""
    base = band * BAND
    bucketed = entries.withColumn("bucket", F.expr(f"lo div {FAN ** (base + BAND)}"))
    rows = bucketed.groupBy("tree", "depth", "bucket").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("l0"))
    for i in range(BAND):
        here = F.col(f"l{i}")
        rows = rows.withColumn(f"n{i}", F.when(F.col("depth") > base + i, _runs(here)).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint,digest:string,kids:array<struct<lo:bigint,hi:bigint,digest:string>>>>")))
        rows = rows.withColumn(f"l{i + 1}", F.when(F.col("depth") > base + i, _plain(F.col(f"n{i}"))).otherwise(here))
    return rows.select("tree", "depth", "bucket", F.get(F.col(f"l{BAND}"), F.lit(0)).alias("top"), F.concat(*[f"n{i}" for i in range(BAND)]).alias("nodes"))


def _steps(nodes: Column, lo: Column, hi: Column) -> Column:
    """From the ancestors of an interval, lowest first: the digests of the siblings before and after it."""
    above = F.filter(nodes, lambda x: (x["lo"] <= lo) & (x["hi"] >= hi))

    def step(x: Column) -> Column:
        before = F.filter(x["kids"], lambda k: k["hi"] <= lo)
        after = F.filter(x["kids"], lambda k: k["lo"] >= hi)
        return F.struct(F.array_join(before["digest"], "").alias("before"), F.array_join(after["digest"], "").alias("after"))

    return F.transform(above, step)


def _trees(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Bands of the trees over leaves (tree, rank, digest), lowest first, and the last node of every tree: tree, root."""
    sizes = leaves.groupBy("tree").agg((F.max("rank") + 1).alias("n"))
    levels = F.size(F.filter(F.array(*map(F.lit, POWERS)), lambda p: p < F.col("n")))
    depths = written(sizes.select("tree", levels.alias("depth")), f"{name}-depths")
    deepest = depths.agg(F.max("depth")).first()[0] or 0
    entries = leaves.join(depths, "tree").select("tree", "depth", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest")
    bands, roots = [], None
    for b in range(max(1, -(-deepest // BAND))):
        rows = written(_climb(entries, b), f"{name}-band")
        bands.append(rows)
        over = rows.where(F.col("depth") <= (b + 1) * BAND).select("tree", F.col("top.digest").alias("root"))
        roots = over if roots is None else roots.unionByName(over)
        entries = rows.where(F.col("depth") > (b + 1) * BAND).select("tree", "depth", "top.*")
    return bands, roots


def _descend(bands: list[DataFrame], above: DataFrame) -> DataFrame:
    """Rows of the lowest band with `upper`, the path of each row's top node through its tree and on through `above` (tree, path)."""
    upper = None
    for b in range(len(bands) - 1, -1, -1):
        last = bands[b].where(F.col("depth") <= (b + 1) * BAND).join(above, "tree").withColumnRenamed("path", "upper")
        rows = last
        if upper is not None:
            wide = FAN ** ((b + 2) * BAND)
            inner = bands[b].where(F.col("depth") > (b + 1) * BAND).withColumn("over", F.expr(f"top.lo div {wide}"))
            met = inner.alias("x").join(upper.select("tree", F.col("bucket").alias("over"), F.col("nodes").alias("above"), "upper").alias("u"), ["tree", "over"])
            path = F.concat(_steps(F.col("above"), F.col("top.lo"), F.col("top.hi")), F.col("upper"))
            rows = last.unionByName(met.select("tree", "depth", "bucket", "top", "nodes", path.alias("upper")))
        upper = rows if b == 0 else written(rows, "paths")
    return upper


def _paths(bands: list[DataFrame], above: DataFrame, leaves: DataFrame) -> DataFrame:
    """Leaves (tree, rank and more) with `path`: the siblings of each, level by level up to the end of `above`."""
    rows = _descend(bands, above).select("tree", "bucket", "nodes", "upper")
    met = leaves.withColumn("bucket", F.expr(f"rank div {WIDTH}")).join(rows, ["tree", "bucket"])
    return met.withColumn("path", F.concat(_steps(F.col("nodes"), F.col("rank"), F.col("rank") + 1), F.col("upper"))).drop("bucket", "nodes", "upper")


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text") -> DataFrame:
    """Digests of every row, of every group and of all, with a proof for each row and a check of the proof against tampered rows.

    A leaf is the sha256 of `fields`, each as `field` writes it. Leaves of a group ascend by id (null first; rows of one id by
    leaf), groups by name (null first, bytewise); runs of three are hashed until one node remains, in each group and then over
    groups. Returns id, leaf, subroot, root, proof_sha256 (of the siblings from the leaf to the root; of nothing for a lone leaf),
    folded_root and verified. Tampering deletes the line breaks of the text where the crc32 of the decimal id is even; a null id
    or text is never tampered with. A row for each row: repeated rows are leaves of their own, and as their leaves are equal
    it is open which of them stands first. An empty table gives none; texts are hashed whole, whatever their length; other
    columns are not read. Digests are taken by built-in functions; no group, tree or level is gathered in one task.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    breaks = F.coalesce(even, F.lit(False)) & F.coalesce(F.contains(text, F.lit("\n")), F.lit(False))
    leaf = digest(F.concat(*[field(F.col(c)) for c in fields]))
    after = digest(F.concat(*[field(F.replace(text, F.lit("\n"), F.lit("")) if c == text_col else F.col(c)) for c in fields]))
    tree = F.concat(F.lit("="), F.col(group_col).cast("string"))
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(tree, F.lit("")).alias("tree"), leaf.alias("digest"), F.when(breaks, after).alias("tampered"), F.monotonically_increasing_id().alias("row"))
    # The number of a row spreads rows that are equal in all else over ranges.
    leaves = with_ranks(written(named, "leaves"), ["id", "digest", "row"], "tree")
    bands, roots = _trees(leaves.select("tree", "rank", "digest"), "tree")
    subroots = written(with_ranks(written(roots.withColumnRenamed("tree", "name"), "subroots"), ["name"]).select("name", "rank", F.col("root").alias("digest"), F.lit("").alias("tree")), "ranked-subroots")
    top, root = _trees(subroots.select("tree", "rank", "digest"), "top")
    nothing = spark.createDataFrame([("", [])], f"tree string, path {PATH}")
    whole = root.select("tree", "root")
    above = _paths(top, nothing, subroots).join(whole, "tree").select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    above = written(above, "above")
    met = _paths(bands, above.select("tree", "path"), leaves).join(above.select("tree", "subroot", "root"), "tree")
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    folded = F.aggregate("path", F.coalesce("tampered", "digest"), lambda h, s: digest(F.concat(s["before"], h, s["after"])))
    out = met.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
