"""Approximate nearest neighbours by robust-pruned directed graphs.

Distinct vectors are dealt into shards of bounded size. In each shard greedy searches over the graph built so far
propose neighbours of every vector, and relaxed distance pruning keeps a diverse few of them as edges. Each shard then meets
waves of queries, which are searched by beam, and the best of all shards are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import written

#: Vectors of a shard, queries that meet a shard in one group, about, and queries that are searched side by side.
SHARD, WAVE, QUERY_BLOCK = 4096, 16_384, 512
#: Edges of a vector, width of the beam when building and when searching, and relaxation of the pruning.
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 24, 40, 48, 1.2


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the `width` nearest vectors found for each query (-1 and inf where fewer), side by
    side for all queries: each step expands every query's nearest unexpanded vector. Vectors and queries have length 1."""
    m, n = len(queries), len(x)
    ids, dist = np.full((m, width), -1, np.int64), np.full((m, width), np.inf, np.float32)
    done = np.ones((m, width), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = start, 2 - 2 * (queries @ x[start]), False
    seen = np.zeros((m, n + 1), bool)
    seen[:, start] = seen[:, n] = True  # n: no neighbour
    rows = np.arange(m)
    while len(rows):
        waiting = np.where(done[rows], np.inf, dist[rows])
        at = waiting.argmin(axis=1)
        on = np.isfinite(waiting[np.arange(len(rows)), at])
        rows, at = rows[on], at[on]
        if not len(rows):
            break
        done[rows, at] = True
        near = graph[ids[rows, at]]
        new = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        d = 2 - 2 * np.einsum("brd,bd->br", x[np.minimum(near, n - 1)], queries[rows])
        d = np.where(new, d, np.inf).astype(np.float32)
        all_d = np.concatenate([dist[rows], d], axis=1)
        all_i = np.concatenate([ids[rows], near], axis=1)
        all_done = np.concatenate([done[rows], ~new], axis=1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        dist[rows] = np.take_along_axis(all_d, keep, 1)
        ids[rows] = np.take_along_axis(all_i, keep, 1)
        done[rows] = np.take_along_axis(all_done, keep, 1)
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def robust_prune(x: np.ndarray, points: np.ndarray, found: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Edges of each point out of its candidates `found` (len(x): none): the nearest is kept, candidates that are nearer
    to it than to the point, by the factor `relax`, are dropped, and so on."""
    n = len(x)
    found = np.sort(found, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = n
    found[found == points[:, None]] = n
    v = x[np.minimum(found, n - 1)]
    d = np.where(found < n, 2 - 2 * np.einsum("bcd,bd->bc", v, x[points]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    found, d = np.take_along_axis(found, order, 1), np.take_along_axis(d, order, 1)
    v = np.take_along_axis(v, order[:, :, None], 1)
    between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive = np.isfinite(d)
    out = np.full((len(points), degree), n, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        at = alive.argmax(axis=1)
        on = alive[rows, at]
        if not on.any():
            break
        out[on, k] = found[rows[on], at[on]]
        alive[on] &= relax * between[rows[on], at[on]] > d[on]
        alive[rows[on], at[on]] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, relax: float = RELAX, batch: int = 512, seed: int = 3) -> tuple[np.ndarray, int]:
    """Edges (vectors by degree, len(x): none) and the start: two rounds of batches over all vectors of length 1."""
    n = len(x)
    start = int((x @ x.mean(axis=0)).argmax())
    if n <= degree + 1:
        everyone = np.broadcast_to(np.arange(n), (n, n))
        graph = everyone[~np.eye(n, dtype=bool)].reshape(n, n - 1)
        return np.hstack([graph, np.full((n, degree - n + 1), n)]), start
    rng = np.random.default_rng(seed)
    graph = rng.integers(0, n, (n, degree))
    for alpha in (1.0, relax):
        for part in np.array_split(rng.permutation(n), -(-n // batch)):
            near, _ = beam_search(x, graph, start, x[part], width)
            near[near < 0] = n
            graph[part] = robust_prune(x, part, np.hstack([near, graph[part]]), degree, alpha)
            # The other way round: new neighbours of each end, in rows of `degree` at most.
            a, b = np.repeat(part, degree), graph[part].reshape(-1)
            a, b = a[b < n], b[b < n]
            order = np.argsort(b, kind="stable")
            a, b = a[order], b[order]
            while len(a):
                first = np.r_[True, b[1:] != b[:-1]]
                place = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
                now = place < degree
                ends, row = np.unique(b[now], return_inverse=True)
                more = np.full((len(ends), degree), n)
                more[row, place[now]] = a[now]
                graph[ends] = robust_prune(x, ends, np.hstack([graph[ends], more]), degree, alpha)
                a, b = a[~now], b[~now]
    return graph, start


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times a power of two, which changes no digit, so that their largest component lies in [0.5, 1): norms and
    products of very small and very large vectors neither vanish nor overflow."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    """Scaled vectors at length 1."""
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct (id, vec) with an id and a vector that has a direction; null ids and null vectors are never usable."""
    read = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return read.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)).distinct()


def distinct_vectors(rows: DataFrame, copies: int) -> DataFrame:
    """node (smallest id), dim, vec and ids (the `copies` smallest) of every distinct vector of `usable` rows. Copies
    beyond these can't be among the answers; each task drops them before the shuffle."""
    keyed = rows.withColumn("key", F.xxhash64("vec"))
    first = keyed.withColumn("at", F.row_number().over(Window.partitionBy("key", "vec").orderBy("id"))).where(F.col("at") <= copies)
    return first.groupBy("key", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("node"), F.size("vec").alias("dim"), "vec", "ids")


def build_index(nodes: DataFrame, shards: int) -> DataFrame:
    """dim, shard, and of each shard: nodes (ids), vecs (doubles), graph and start. Every vector is in one shard."""

    def run(table: pa.Table) -> pa.Table:
        dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
        table = table.sort_by("node")
        v = _matrix(table["vec"], dim)
        graph, start = build_graph(_unit(_scaled(v)))
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "nodes": [table["node"].to_numpy().astype("<i8").tobytes()], "vecs": [v.astype("<f8").tobytes()], "graph": [graph.astype("<i4").tobytes()], "start": pa.array([start], pa.int32())})

    dealt = nodes.select("node", "dim", "vec", F.pmod(F.xxhash64("node", F.lit(13)), F.lit(shards)).cast("int").alias("shard"))
    # More partitions than shards, so that few of them hold two.
    return dealt.repartition(2 * shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, nodes binary, vecs binary, graph binary, start int")


def search_index(index: DataFrame, queries: DataFrame, shards: int, waves: int, k: int, width: int = SEARCH_BEAM) -> DataFrame:
    """query_id, node, score (cosine of the original vectors, in double precision): the best k + 1 nodes of each shard
    for each query (id, dim, vec), the query's own node among them where it is there. A group is one shard, decoded once,
    and one of `waves` waves of queries."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            nodes = np.frombuffer(left["nodes"][0].as_py(), "<i8")
            v = _scaled(np.frombuffer(left["vecs"][0].as_py(), "<f8").reshape(-1, dim))
            edges = np.frombuffer(left["graph"][0].as_py(), "<i4").reshape(len(v), -1).astype(np.int64)
            unit, lengths, start = _unit(v), np.linalg.norm(v, axis=1), left["start"][0].as_py()
            ids, asked = right["id"].to_numpy(), _scaled(_matrix(right["vec"], dim))
            for i in range(0, len(ids), QUERY_BLOCK):
                q = asked[i : i + QUERY_BLOCK]
                found, _ = beam_search(unit, edges, start, _unit(q), min(width, len(v)))
                at = np.maximum(found, 0)
                score = np.einsum("qkd,qd->qk", v[at], q) / (lengths[at] * np.linalg.norm(q, axis=1)[:, None])
                score = np.where(found >= 0, score, -np.inf)
                best = np.lexsort((nodes[at], -score), axis=1)[:, : k + 1]
                score, who = np.take_along_axis(score, best, 1), np.take_along_axis(nodes[at], best, 1)
                on = np.isfinite(score)
                for held, x in zip(out, (np.repeat(ids[i : i + QUERY_BLOCK], on.sum(axis=1)), who[on], score[on]), strict=True):
                    held.append(x)
        whole = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table(dict(zip(("query_id", "node", "score"), whole, strict=True)))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(waves)).cast("int")
    keys = ["dim", "shard", "wave"]
    asked = queries.select("id", "dim", "vec", own.alias("wave"), every(shards).alias("shard"))
    held = index.withColumn("wave", every(waves))
    pair = [x.repartition(2 * shards * waves, *keys).groupBy(*keys) for x in (held, asked)]
    return pair[0].cogroup(pair[1]).applyInArrow(run, "query_id long, node long, score double")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """The k nearest rows by cosine of every row whose id is divisible by `every`: query_id, rank (from 1), vec_id, score.

    Candidates are all other rows of the same dimension, all if there are fewer than k; ties go to the smaller id. Rows
    with a null id, or a vector that is null, empty, zero or holds null or non-finite components, take no part. Equal
    vectors are one node of the graph, from which their k + 1 smallest ids come back. Rows that repeat id and vector
    count once; an id with several vectors keeps them all as candidates and queries. Vectors of any
    magnitude count by their direction. Other columns, whatever their names, are not read. An empty table gives an empty result. Every vector is indexed and every shard is searched, so only the
    walk within a shard is approximate; the score is exact.
    """
    rows = usable(vectors, id_col, vec_col)
    nodes = written(distinct_vectors(rows, k + 1), "nodes")
    total = nodes.count()
    shards = max(1, -(-total // shard))
    index = written(build_index(nodes, shards), "index")
    members = nodes.select("node", "ids")
    asked = written(rows.where(F.col("id") % every == 0).withColumn("dim", F.size("vec")), "queries")
    found = search_index(index, asked, shards, max(1, -(-asked.count() // WAVE)), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    best = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1).select("query_id", "node", "score")
    near = best.join(members, "node").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
