"""Near duplicates by min-max hashing.

Each hash evaluation of a shingle gives two signature values, its permutation's minimum and maximum. Bands are made of
minima only or of maxima only, so that the rows of one band come from different permutations and a band agrees with
probability J ** rows. Half of the hash evaluations of plain minwise hashing give the same number of bands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import ChunkCache, grouped, small_batches, tool, written
from .components import connected_components

#: Elements of a block of hash evaluations (shingles times permutations).
BLOCK = 1 << 18
#: Rows of a bucket, and rows that ask in it, that meet in one group while sketches are compared.
SKETCH_ROWS, SKETCH_ASKS = 1024, 1024
#: The same in shingles while full sets are compared, so that a group's memory does not follow the length of texts.
SET_ROWS, SET_ASKS = 1 << 18, 1 << 20
#: Nodes up to so many are sent to the texts; beyond that the texts are joined by shuffle.
BROADCAST_NODES = 1_000_000
#: Places (a power of two) of the table that estimates how frequent shingles are. It has this size for any number of rows.
PLACES = 1 << 20


class Shingler:
    """Distinct word shingles of texts as sorted arrays of 64-bit hashes."""

    def __init__(self, words: int):
        self.words = words
        self.known = ChunkCache(lambda found: list(map(xxhash.xxh3_64_intdigest, found)))
        self.weights = np.random.default_rng(7).integers(0, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """`bytes.lower` and `bytes.split` treat A-Z and the six ASCII white space characters, and nothing else."""
        lists = [x.lower().split() if x else [] for x in texts]
        self.known.learn(lists)
        get, k = self.known.__getitem__, self.words
        out = []
        for found in lists:
            n = len(found)
            if not n:
                out.append(np.zeros(0, np.uint64))
                continue
            h = np.fromiter(map(get, found), np.uint64, n)
            m = min(k, n)
            total = np.full(n - m + 1, m * 0x9E3779B1, dtype=np.uint64)
            for i in range(m):
                total += h[i : n - m + 1 + i] * self.weights[i]
            total ^= total >> np.uint64(31)
            total *= np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
            out.append(np.unique(total))
        return out


class MinMax:
    """Band keys of shingle sets."""

    def __init__(self, bands: int, rows: int):
        half = -(-bands // 2)
        self.bands, self.rows, self.half = bands, rows, half
        rng = np.random.default_rng(11)
        self.a = rng.integers(0, 1 << 31, half * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, half * rows, dtype=np.uint32)
        self.mix = rng.integers(0, 1 << 63, (rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.place = rng.integers(0, 1 << 63, 2 * half, dtype=np.uint64)

    def extremes(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Minimum and maximum of the set under every permutation."""
        x = (found >> np.uint64(32)).astype(np.uint32)
        k = len(self.a)
        step = max(1, BLOCK // k)
        low, high = np.full(k, 0xFFFFFFFF, np.uint32), np.zeros(k, np.uint32)
        for i in range(0, len(x), step):
            v = self.a[:, None] * x[None, i : i + step]
            v += self.b[:, None]
            np.minimum(low, v.min(axis=1), out=low)
            np.maximum(high, v.max(axis=1), out=high)
        return low, high

    def keys(self, found: np.ndarray) -> np.ndarray:
        return self.signature(found)[0]

    def signature(self, found: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Band keys, and the low byte of every minimum and maximum, which two sets share with about probability J."""
        low, high = self.extremes(found)
        sketch = np.concatenate([low, high]).astype(np.uint8).tobytes()
        both = np.concatenate([low, high]).astype(np.uint64).reshape(2 * self.half, self.rows)
        key = (both + np.uint64(1)) @ self.mix.reshape(-1) + self.place
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
        return key[: self.bands].view(np.int64), sketch


def _tools(words: int, bands: int, rows: int) -> tuple[Shingler, MinMax]:
    return tool(("near_dup", words, bands, rows), lambda: (Shingler(words), MinMax(bands, rows)))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """id, n (set size), d1, d2 (digest of the set), keys (of the bands) and sketch, a row for each row."""

    def run(batches):
        shingler, minmax = _tools(words, bands, rows)
        for batch in batches:
            start = 0
            texts = batch.column(1).to_pylist()
            for group in grouped(texts, lambda x: len(x) if x else 0):
                sets = shingler.sets(group)
                ids = batch.column(0).slice(start, len(group))
                start += len(group)
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                both = [minmax.signature(s) if len(s) else (np.zeros(0, np.int64), b"") for s in sets]
                keys = [k for k, _ in both]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(keys, pa.list_(pa.int64())), pa.array([x for _, x in both], pa.binary())],
                    ["id", "n", "d1", "d2", "keys", "sketch"],
                )

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return read.mapInArrow(run, "id long, n long, d1 long, d2 long, keys array<long>, sketch binary")


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(key, node, lo, hi): the rows of all buckets with more than one class; lo and hi are a bucket's extreme nodes."""
    rows = classes.select("node", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    return rows.join(buckets, "key").select("key", "node", "lo", "hi")


def star_pairs(met: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of every node with the smallest and the largest one of each of its buckets: they grow with the
    bucket and not with its square."""
    ends = F.array(F.struct(F.col("lo").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("hi").alias("b")))
    return met.select(F.explode(ends).alias("p")).select("p.a", "p.b").where("a < b").distinct()


def _split(rows: DataFrame) -> DataFrame:
    """Adds asks (whether a row lies outside of the bucket's component with the most rows) to rows (key, node, comp, n) of
    buckets with more than one component; other buckets go."""
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    sums = parts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("total")).where(F.col("m.c") < F.col("total"))
    return rows.join(sums.select("key", F.col("m.comp").alias("major")), "key").withColumn("asks", F.col("comp") != F.col("major")).drop("major")


def blocked(work: DataFrame, weight: Column, rows: int, asking: int) -> DataFrame:
    """The rows (key, node, comp, asks, ...) with ask and block: a bucket's rows are dealt to blocks of about
    `rows` by weight, and its asking rows to waves of about `asking`. Every row stands in its own block once for each wave,
    and every asking row in its own wave once for each block, so that every asking row meets every row in one group."""
    sums = work.groupBy("key").agg(F.sum(weight).alias("total"), F.coalesce(F.sum(F.when(F.col("asks"), weight)), F.lit(0)).alias("others"))
    sized = work.join(sums.where("others > 0"), "key")
    blocks, waves = (F.greatest(F.ceil(F.col(n) / most), F.lit(1)).cast("long") for n, most in (("total", rows), ("others", asking)))
    own, wave = F.pmod(F.xxhash64("node", F.lit(3)), blocks), F.pmod(F.xxhash64("node", F.lit(4)), waves)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    kept = [c for c in work.columns if c != "asks"]
    here = sized.select(*kept, F.lit(False).alias("asks"), every(waves).alias("ask"), own.alias("block"))
    asks = sized.where("asks").select(*kept, F.lit(True).alias("asks"), wave.alias("ask"), every(blocks).alias("block"))
    return here.unionByName(asks)


def _need(width: int, percent: int) -> float:
    """Places in which the sketches of a linked pair agree at least, less five standard deviations."""
    share = percent / 100
    return width * share - 5 * np.sqrt(width * share * (1 - share))


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Sketches as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    width = len(column[0].as_py())
    packed = column.cast(pa.binary(width))
    return np.frombuffer(packed.buffers()[1], np.uint8)[packed.offset * width :][: len(packed) * width].reshape(-1, width)


def promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches do not rule a link out."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                left, right = _sketches(batch.column(2)), _sketches(batch.column(3))
                at = pa.array(np.flatnonzero((left == right).sum(axis=1) >= _need(left.shape[1], percent)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    met = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return met.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def sets_of(texts: DataFrame, nodes: DataFrame, words: int, repeats: bool) -> DataFrame:
    """(node, set) of distinct nodes: the sorted hashes of their shingles. `texts`: id, text (binary). Only texts of nodes
    leave their place, and their sets, not they, are shuffled later. `repeats`: whether an id may stand in several rows."""
    nodes = written(nodes, "nodes")
    here = texts.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes, texts["id"] == nodes["node"], "left_semi")
    here = here.distinct() if repeats else here

    def run(batches):
        shingler, _ = _tools(words, 2, 1)
        for batch in batches:
            start = 0
            for group in grouped(batch.column(1).to_pylist(), lambda x: len(x) if x else 0):
                sets = [x.tobytes() for x in shingler.sets(group)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(group)), pa.array(sets, pa.binary())], ["node", "set"])
                start += len(group)

    return written(here.select("id", "text").mapInArrow(run, "node long, set binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets satisfy 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many of the first shingles, in an order that all sets share, a set of `n` needs so that it has one in common with
    every set it is linked with: (against sets that are as large or larger, against sets that are as large or smaller).

    Of two linked sets the smaller one, of size n, shares at least 2 * percent * n / (100 + percent) shingles, and the larger
    one, of size n, at least percent * n / 100. Where o shingles are shared, the first n - o + 1 of both sets share one.
    """
    return n + 1 - -(-2 * percent * n // (100 + percent)), n + 1 - -(-percent * n // 100)


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """Upper bounds of the number of sets that hold a shingle, by the place of its hash in a table of PLACES."""

    def run(batches):
        table = np.zeros(PLACES, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                np.add.at(table, (np.frombuffer(x, np.uint64) % np.uint64(PLACES)).view(np.int64), 1)
        at = np.flatnonzero(table)
        for i in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(table[at[i : i + 50_000]])], ["place", "c"])

    found = sets.select("set").mapInArrow(run, "place long, c long").groupBy("place").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(PLACES, np.int64)
    out[found["place"].to_numpy()] = found["c"].to_numpy()
    return out


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, leads): the first shingles of each set (node, set), the rarest first. leads: whether the set may meet
    sets that are as large or larger there. Shingles that no other set can hold are left out."""
    counts = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets))

    def run(batches):
        often = counts.value
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for node, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(x, np.uint64)
                lead, most = prefix_lengths(len(found), percent)
                c = often[(found % np.uint64(PLACES)).view(np.int64)]
                first = np.lexsort((found, c))[:most]
                leads = np.arange(len(first)) < lead
                on = c[first] > 1
                first, leads = first[on], leads[on]
                out.append((found[first].view(np.int64), np.full(len(first), node), np.full(len(first), len(found)), leads))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                for i in range(0, len(columns[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in columns], ["token", "node", "n", "leads"])

    return sets.select("node", "set").mapInArrow(run, "token long, node long, n long, leads boolean")


def sharing(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, leads): groups of sets that share one of their first shingles, one of them leading there. Linked sets of
    different nodes meet in one group at least, where the smaller one leads; groups of equal members are one."""
    rows = written(prefixes(sets, percent).withColumnRenamed("token", "key"), "prefixes")
    mark = F.xxhash64("node", "n", "leads")
    halves = [F.sum(F.shiftrightunsigned(mark, 32)).alias("s1"), F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s2")]
    ends = [F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("leads").alias("on"), F.count("*").alias("c")]
    groups = rows.groupBy("key").agg(*ends, *halves).where("lo < hi and on")
    return rows.join(groups.groupBy("lo", "hi", "c", "s1", "s2").agg(F.min("key").alias("key")).select("key"), "key")


def _meeting(percent: int):
    """Pairs (a, b) that connect the nodes of a group which may be linked, told by sizes, leading shingles and sketches:
    each such node and the first one that it is connected with."""

    def run(table: pa.Table) -> pa.Table:
        asks, comp, n, leads, node = (table[c].to_numpy() for c in ("asks", "comp", "n", "leads", "node"))
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(left) or not len(right):
            return pa.table({"a": node[:0], "b": node[:0]})
        x, y = left[:, None], right[None, :]
        on = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        on &= (leads[x] & (n[x] <= n[y])) | (leads[y] & (n[y] <= n[x]))
        sketch = _sketches(table["sketch"])
        need = _need(sketch.shape[1], percent)
        i, j = np.nonzero(on)
        for k in range(0, len(i), 50_000):
            part = slice(k, k + 50_000)
            on[i[part], j[part]] = (sketch[left[i[part]]] == sketch[right[j[part]]]).sum(axis=1) >= need
        i, j = np.nonzero(on)
        order = np.argsort(j, kind="stable")
        (mine, at), (theirs, there) = np.unique(i, return_index=True), np.unique(j[order], return_index=True)
        low = np.arange(len(node))  # the smallest place that a row is connected with
        while len(i):
            old = low.copy()
            low[left[mine]] = np.minimum(low[left[mine]], np.minimum.reduceat(low[right[j]], at))
            low[right[theirs]] = np.minimum(low[right[theirs]], np.minimum.reduceat(low[left[i[order]]], there))
            if (low == old).all():
                break
        p, q = node, node[low]
        seen = p != q
        return pa.table({"a": np.minimum(p, q)[seen], "b": np.maximum(p, q)[seen]})

    return run


def _linking(percent: int):
    """Links of a group between asking rows and rows, by full sets: a spanning forest over the components, so that there
    are fewer of them than rows."""

    def run(table: pa.Table) -> pa.Table:
        asks, node, comp = (table[c].to_numpy() for c in ("asks", "node", "comp"))
        sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            known = np.unique(np.concatenate([sets[i] for i in right]))
            ids = np.searchsorted(known, np.concatenate([sets[i] for i in right]))
            sizes = np.array([len(sets[i]) for i in right])
            starts, mark, root = np.cumsum(sizes) - sizes, np.zeros(len(known), np.int32), {}

            def top(x):
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            for i in left:
                mine = sets[i]
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                at = at[known[at] == mine]
                mark[at] = 1
                both = np.add.reduceat(mark[ids], starts)
                mark[at] = 0
                for j in np.flatnonzero((100 * both >= percent * (sizes + len(mine) - both)) & (comp[right] != comp[i])):
                    a, b = top(comp[i]), top(comp[right[j]])
                    if a != b:
                        root[a] = b
                        found.append((node[i], node[right[j]]))
        a, b = (np.array([p[k] for p in found], np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def missing_links(met: DataFrame, classes: DataFrame, parts: DataFrame, sets, percent: int) -> DataFrame:
    """Links that connect all components whose nodes share a bucket and are linked.

    The nodes of buckets that hold more than one component meet by prefix: their shingles are put into one order, the rarest
    first, and linked sets share one of their first shingles (`sharing`), so that nodes which have only frequent shingles in
    common do not meet. In each such group that holds more than one component, the rows outside of its largest component
    (they ask) are held against all of its rows by sketch. What may be linked is connected, and within what is connected,
    where a node stands once, full sets are compared in the same way (`sets` gives them for a table of nodes). Both times
    rows meet in groups of bounded size, however many there are, and a group gives back fewer rows than it has.
    """
    named = written(classes.select("node").distinct().join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("comp")), "components")
    open_ = met.select("key", "node").join(named, "node").groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b")
    held = sets(met.select("key", "node").join(open_.select("key"), "key", "left_semi").select("node").distinct())
    work = written(_split(sharing(held, percent).join(named, "node")), "unresolved")
    near = blocked(work, F.lit(1), SKETCH_ROWS, SKETCH_ASKS).join(classes.select("node", "sketch"), "node")
    near = near.groupBy("key", "ask", "block").applyInArrow(_meeting(percent), "a long, b long").distinct()
    near = connected_components(written(near, "near")).select("node", F.col("component").alias("key")).join(named, "node")
    sizes = held.groupBy("node").agg(F.max(F.length("set") / 8).cast("long").alias("n"))
    rows = written(_split(near.join(sizes, "node")), "rows")
    far = blocked(rows, F.col("n"), SET_ROWS, SET_ASKS).join(held, "node")
    return far.groupBy("key", "ask", "block").applyInArrow(_linking(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, bands: int = 48, rows: int = 5) -> DataFrame:
    """Groups of near-duplicate texts: id, n_shingles, component_id, kept, a row for each row of `docs`.

    Words are runs without ASCII white space after lower-casing A-Z; a set has the distinct shingles of `words` words,
    or the whole sequence if there are fewer. Sets with 100 * intersection >= percent * union are linked; component_id
    is the smallest id that links reach; kept is true for that row. Null, empty and white texts have no shingles, are
    linked with nothing and are kept. Equal sets form one class, so copies never become pairs. Rows that repeat an id
    count as one document and stay as many rows; a row without an id takes its class's component and isn't kept
    unless it has no shingles either way. Other columns, whatever their names, are not read. An empty table gives an
    empty result. At a similarity of 0.75 a link is missed by all bands with probability (1 - 0.75 ** rows) ** bands,
    about 2e-6; every link is confirmed on full sets. Stars within buckets find most links; what they leave apart is
    compared by missing_links, so that no link between components is lost to the choice of a star's centre. A text of any
    length is one set of hashes of its shingles, held alone if it is very long.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    signed = written(signatures(read, id_col, text_col, words, bands, rows), "signatures")
    some = signed.where("n > 0 and id is not null")
    first = F.min(F.struct("id", "keys", "sketch")).alias("m")
    classes = written(some.groupBy("d1", "d2", "n").agg(first).select("d1", "d2", "n", F.col("m.id").alias("node"), F.col("m.keys").alias("keys"), F.col("m.sketch").alias("sketch")), "classes")
    texts = read.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    repeats = not some.groupBy("id").count().where("count > 1").isEmpty()
    sets = lambda nodes: sets_of(texts, nodes, words, repeats)
    met = written(bucket_rows(classes), "buckets")
    pairs = written(promising(star_pairs(met), classes, percent), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = written(confirmed(pairs, sets(ends), percent), "links")
    parts = connected_components(links)
    more = written(missing_links(met, classes, parts, sets, percent), "links")
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more))
    named = classes.select("d1", "d2", "node").join(parts, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))
    out = signed.select("id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.col("n") == 0).alias("kept"))
