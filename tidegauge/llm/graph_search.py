"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards of bounded size by a hash.  In a shard, vectors join the
graph in batches: a greedy search from the entry point proposes neighbours, and robust
pruning keeps the closest and then only those that are not much closer to one kept
already than to the new vector (relaxed by ``alpha``), so that edges stay diverse.
Kept neighbours link back and are pruned when they have too many edges.  A second pass
over the finished graph does the same with the relaxed distance.  Queries beam-search
every shard, a block of queries at a time, and the best of all shards are merged.

The largest inner product is the smallest distance once each vector gets one more
component that makes all norms in a shard equal, so the graph can be built with
distances.

Equal vectors are one node: a node keeps its smallest ``k + 1`` ids, which are all that
any query can need, as ties go to the smaller id; equal queries are searched once.
This loses nothing and keeps a vector with very many copies from filling a shard.

Defined cases: vectors that are null, all zero, or hold null or non-finite components
take no part, neither do rows with a null id.  Vectors of different lengths are never compared.
Repeated rows (id and vector) are one candidate.  With fewer candidates than ``k`` all
that are found are returned.  An empty table gives an empty result.  Other columns of
the input are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.shared import stash

#: Edges of a node, breadth of the searches that build and of those that query, and the relaxation.
DEGREE, BREADTH, BEAM, ALPHA = 32, 64, 96, 1.2
#: Vectors of a shard and distinct queries of a block, on average.
SHARD, QUERIES = 4096, 8192
BATCH = 256


def beam_search(vectors: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``breadth`` nearest nodes met (-1: none) and their distances.

    All queries take a step together: each opens its nearest node that is not open yet,
    and goes on until its ``breadth`` nearest are all open.
    """
    n = len(queries)
    norm = np.einsum("ij,ij->i", vectors, vectors)
    best = np.full((n, breadth), -1, np.int64)
    far = np.full((n, breadth), np.inf, np.float32)
    done = np.ones((n, breadth), bool)
    seen = np.zeros((n, len(vectors)), bool)
    best[:, 0], seen[:, entry], done[:, 0] = entry, True, False
    far[:, 0] = norm[entry] - 2 * queries @ vectors[entry]
    live = np.arange(n)
    while len(live):
        nearest = np.argmin(np.where(done[live], np.inf, far[live]), axis=1)
        done[live, nearest] = True
        next_ = edges[best[live, nearest]]
        new = (next_ >= 0) & ~seen[live[:, None], next_]
        rows, cols = np.nonzero(new)
        to = next_[rows, cols]
        seen[live[rows], to] = True
        distance = np.full(next_.shape, np.inf, np.float32)
        distance[rows, cols] = norm[to] - 2 * np.einsum("ij,ij->i", queries[live[rows]], vectors[to])
        all_far = np.concatenate([far[live], distance], axis=1)
        keep = np.argpartition(all_far, breadth - 1, axis=1)[:, :breadth]
        take = lambda x: np.take_along_axis(x, keep, axis=1)  # noqa: B023, E731
        far[live] = take(all_far)
        best[live] = take(np.concatenate([best[live], next_], axis=1))
        done[live] = take(np.concatenate([done[live], ~new], axis=1)) | ~np.isfinite(far[live])
        live = live[~done[live].all(axis=1)]
    best[~np.isfinite(far)] = -1
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(best, order, axis=1), np.take_along_axis(far, order, axis=1)


def pruned(vectors: np.ndarray, nodes: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning for each of ``nodes`` among its candidates ``near`` (-1: none)."""
    own = vectors[nodes]
    safe = np.maximum(near, 0)
    them = vectors[safe]
    distance = np.einsum("ijk,ijk->ij", them - own[:, None], them - own[:, None])
    distance[(near < 0) | (near == nodes[:, None])] = np.inf
    order = np.argsort(distance, axis=1, kind="stable")
    near, distance, them = np.take_along_axis(near, order, 1), np.take_along_axis(distance, order, 1), np.take_along_axis(them, order[:, :, None], 1)
    same = np.concatenate([np.zeros((len(nodes), 1), bool), near[:, 1:] == near[:, :-1]], axis=1)
    distance[same] = np.inf
    norm = np.einsum("ijk,ijk->ij", them, them)
    between = norm[:, :, None] + norm[:, None, :] - 2 * them @ them.transpose(0, 2, 1)
    out, rows = np.full((len(nodes), degree), -1, np.int64), np.arange(len(nodes))
    for k in range(degree):
        pick = np.argmin(distance, axis=1)
        some = np.isfinite(distance[rows, pick])
        if not some.any():
            break
        out[some, k] = near[rows, pick][some]
        covered = alpha * alpha * between[rows, pick] <= distance
        distance[covered & some[:, None]] = np.inf
        distance[rows, pick] = np.inf
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, breadth: int = BREADTH, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges of each node (-1: none) and the entry point."""
    n = len(vectors)
    middle = vectors.mean(axis=0)
    entry = int(np.argmin(((vectors - middle) ** 2).sum(axis=1)))
    edges = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(n).permutation(n)
    for relaxed in (1.0, alpha):
        size = 1 if relaxed == 1.0 else BATCH  # batches grow with the graph
        at = 0
        while at < n:
            some = order[at : at + size]
            at += size
            size = min(BATCH, 2 * size)
            near, _ = beam_search(vectors, edges, entry, vectors[some], breadth)
            near = np.concatenate([near, edges[some]], axis=1)
            edges[some] = pruned(vectors, some, near, degree, relaxed)
            # Links back: those who have room take them, the others prune.
            rows, cols = np.nonzero(edges[some] >= 0)
            to, back = edges[some][rows, cols], some[rows]
            by = np.argsort(to, kind="stable")
            to, back = to[by], back[by]
            nodes, start, many = np.unique(to, return_index=True, return_counts=True)
            more = np.full((len(nodes), many.max(initial=0)), -1, np.int64)
            more[np.repeat(np.arange(len(nodes)), many), np.arange(len(to)) - np.repeat(start, many)] = back
            both = np.concatenate([edges[nodes], more], axis=1)
            count = np.array([len(np.unique(r[r >= 0])) for r in both]) if len(both) else np.zeros(0, int)
            fit = count <= degree
            for node, r in zip(nodes[fit], both[fit], strict=True):
                u = np.unique(r[r >= 0])
                edges[node, : len(u)], edges[node, len(u) :] = u, -1
            if (~fit).any():
                edges[nodes[~fit]] = pruned(vectors, nodes[~fit], both[~fit], degree, relaxed)
    return edges, entry


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v.values, np.float64) for v in column])


def scaled(vectors: np.ndarray, axis: int | None = None) -> np.ndarray:
    """In single precision, times a power of two (for all, or for each row) that makes the
    largest component about 1, so that no finite vector overflows."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=axis, keepdims=True))
    return np.ldexp(vectors, -exponent).astype(np.float32)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """With one more component that makes all norms equal."""
    square = (vectors.astype(np.float64) ** 2).sum(axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(0, square.max() - square))[:, None].astype(np.float32)], axis=1)


def index_shard(table: pa.Table) -> pa.Table:
    """Adds its edges and whether it is the entry to each node of a shard."""
    vectors = lifted(scaled(_matrix(table.column("vector"))))
    edges, entry = build(vectors)
    first = np.arange(len(vectors)) == entry
    return table.append_column("edges", pa.array(list(edges.astype(np.int32)), pa.list_(pa.int32()))).append_column("place", pa.array(np.arange(len(vectors), dtype=np.int32))).append_column("entry", pa.array(first))


def search_shard(k: int, beam: int):
    """The best ``k + 1`` ids in a shard for each query of a block."""

    def run(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query", "vec_id", "score"]
        if not nodes.num_rows or not queries.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        nodes = nodes.sort_by("place")
        precise, asked = (_matrix(t.column("vector")) for t in (nodes, queries))
        vectors = lifted(scaled(precise))
        edges = np.stack([np.asarray(e.values, np.int64) for e in nodes.column("edges")])
        entry = int(np.flatnonzero(nodes.column("entry").to_numpy())[0])
        members = nodes.column("members").to_pylist()
        ids = queries.column("query").to_numpy()
        flat = np.concatenate([scaled(asked, axis=1), np.zeros((len(asked), 1), np.float32)], axis=1)
        out = []
        for at in range(0, len(flat), 512):
            near, _ = beam_search(vectors, edges, entry, flat[at : at + 512], min(beam, len(vectors)))
            exact = np.einsum("ijk,ik->ij", precise[np.maximum(near, 0)], asked[at : at + 512])
            for query, places, scores in zip(ids[at : at + 512].tolist(), near.tolist(), exact.tolist(), strict=True):
                found = [(-s, v) for p, s in zip(places, scores, strict=True) if p >= 0 for v in members[p]]
                out += [(query, v, -s) for s, v in sorted(found)[: k + 1]]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=names)

    return run


def usable(table: DataFrame, vector: str, id: str) -> DataFrame:
    """vec_id and vector of the rows that take part."""
    kept = table.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where("vec_id is not null and vector is not null")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return kept.where(sound & F.exists("vector", lambda x: x != 0))


def nearest(table: DataFrame, k: int = 20, every: int = 20, shard: int = SHARD, block: int = QUERIES, beam: int = BEAM, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest found for each row whose id
    is divisible by ``every``, among all other rows."""
    rows = usable(table, vector, id)
    # The smallest k + 1 ids of each distinct vector; Spark limits each task's rows before they move.
    ranked = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    nodes = stash(ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).withColumns({"node": F.col("members")[0], "size": F.size("vector")}), "nodes")
    total = nodes.groupBy("size").count()
    shards = F.ceil(F.col("count") / shard)
    numbered = nodes.join(F.broadcast(total.withColumn("shards", shards).drop("count")), "size")  # one row for each length of vectors
    graphs = stash(numbered.withColumn("shard", F.pmod(F.xxhash64("node"), "shards")).select("size", "shard", "vector", "members").groupBy("size", "shard").applyInArrow(index_shard, nodes_schema(nodes)), "graphs")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    named = stash(asked.join(nodes.select("vector", F.col("node").alias("query")), "vector"), "queries")
    distinct = named.groupBy("query").agg(F.first("vector").alias("vector")).withColumn("size", F.size("vector"))
    counts = distinct.groupBy("size").count().withColumn("blocks", F.ceil(F.col("count") / block)).drop("count")
    per = total.withColumn("shards", shards).drop("count").join(counts, "size")
    placed = distinct.join(F.broadcast(per), "size").withColumn("block", F.pmod(F.xxhash64("query"), "blocks"))
    # Every block of queries meets every shard once.
    spread = placed.select("size", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "query", "vector")
    copies = graphs.join(F.broadcast(counts), "size").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).drop("blocks")
    met = copies.groupBy("size", "shard", "block").cogroup(spread.groupBy("size", "shard", "block")).applyInArrow(search_shard(k, beam), "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    merged = stash(met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found")), "found")
    each = named.select("query_id", "query").join(merged, "query")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(others)).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))


def nodes_schema(nodes: DataFrame) -> str:
    return f"size int, shard long, vector {nodes.schema['vector'].dataType.simpleString()}, members array<long>, edges array<int>, place int, entry boolean"
