"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one for each shard.

Equal vectors are one node; a node carries its k + 1 least vec_ids, which is all a query can need. Nodes are dealt into bands whose norms differ by a factor of BAND at most, and
a band over shards of about SHARD_ROWS by a hash of the vector. A task builds a shard's graph: nodes draw their top level by a hash; on each level a node's neighbours are chosen from its
nearest nodes by the diversity rule, then links back are added. Each level is one flat array of neighbour numbers (fixed width, -1 for none). The
last place on level 0 is a ring through all nodes, so every node can be reached. Graphs are rows of an index table in the shared folder.

Queries come in blocks of QUERY_ROWS. A task reads a shard's graph once and then up to PART_BLOCKS blocks of queries; all queries of a block descend together: greedy steps on the upper
levels, then a beam of EF nodes on level 0. Graphs are walked in single precision on vectors scaled to norms of at most 1; found nodes are scored again in double precision on the
original vectors, and the shards' results are merged. Every query meets every shard of its dimension, so the work grows with queries times shards.

Nearness is the largest inner product. A graph links vectors by their angles and is walked by inner products, which within a band of norms tell nearly the same order; long vectors
have bands, and so graphs, of their own and can't become everyone's neighbour. A score that overflows to no number comes last.
Only vectors of equal length are compared. Null, zero, empty vectors and those with null or non-finite components take no part, nor do rows without a vec_id. Repeated
rows are candidates each. Of rows that share a vec_id the one with the least vector asks; its candidates are all other rows, those of its own vec_id too. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm import common

K = 20
SHARD_ROWS = 16_384
#: Norms of a band's vectors differ by no more than this factor.
BAND = 1.5
QUERY_ROWS, PART_BLOCKS = 256, 32
#: Up to so many bands are broadcast with their numbers of shards; beyond, they meet the vectors in a shuffled join.
BROADCAST_BANDS = 10_000
#: Links of a node above and on level 0, nearest nodes that they are chosen from, beam width, nodes expanded in a step.
M, M0, CHOICE, EF, EXPAND = 16, 32, 64, 320, 4


def _nearest(x: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the ``width`` nearest other rows of each row, nearest first."""
    n = len(x)
    out = np.empty((n, width), np.int64)
    for a in range(0, n, 1024):
        sim = x[a : a + 1024] @ x.T
        sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -np.inf
        top = np.argpartition(-sim, width - 1, axis=1)[:, :width] if width < n else np.argsort(-sim, axis=1)[:, :width]
        own = np.take_along_axis(sim, top, 1)
        out[a : a + 1024] = np.take_along_axis(top, np.argsort(-own, axis=1, kind="stable"), 1)
    return out


def _links(x: np.ndarray, most: int) -> np.ndarray:
    """A level's neighbour array (rows of ``x`` by ``most``)."""
    n = len(x)
    found = np.full((n, most), -1, np.int32)
    if n < 2:
        return found
    near = _nearest(x, min(CHOICE, n - 1))
    kept = np.zeros(near.shape, bool)
    for a in range(0, n, 512):
        c = near[a : a + 512]
        vectors = x[c]
        to_own = np.einsum("ncd,nd->nc", vectors, x[a : a + 512])
        between = vectors @ vectors.transpose(0, 2, 1)
        ok = np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            closest = np.where(ok[:, :j], between[:, j, :j], -np.inf).max(1, initial=-np.inf)
            ok[:, j] = (to_own[:, j] > closest) & (ok.sum(1) < most)
        kept[a : a + 512] = ok
    source, place = np.nonzero(kept)
    target = near[source, place]
    # Links as chosen come first, then links back by nearness; each pair once.
    s, t = np.concatenate([source, target]), np.concatenate([target, source])
    rank = np.concatenate([np.zeros(len(source)), np.ones(len(source))])
    sim = np.concatenate([np.einsum("nd,nd->n", x[i], x[j]) for i, j in zip(np.array_split(s, len(s) // 100_000 + 1), np.array_split(t, len(s) // 100_000 + 1))])
    _, first = np.unique(s * n + t, return_index=True)
    s, t, rank, sim = s[first], t[first], rank[first], sim[first]
    order = np.lexsort((t, -sim, rank, s))
    s, t = s[order], t[order]
    begin = np.searchsorted(s, np.arange(n))
    at = np.arange(len(s)) - begin[s]
    fits = at < most
    found[s[fits], at[fits]] = t[fits]
    return found


class Graph:
    """Flat arrays: vectors, nodes of each level above 0, and neighbours by level (numbers of nodes)."""

    def __init__(self, vectors: np.ndarray, above: list[np.ndarray], links: list[np.ndarray]):
        self.vectors, self.above, self.links = vectors, above, links

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 11) -> Graph:
        n, x = len(vectors), scaled(vectors, True)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(int)
        above, links = [], []
        base = _links(x, M0)
        base[:, -1] = (np.arange(n) + 1) % n if n > 1 else -1
        links.append(base)
        for step in range(1, level.max(initial=0) + 1):
            nodes = np.flatnonzero(level >= step)
            local = _links(x[nodes], M)
            above.append(nodes.astype(np.int32))
            links.append(np.where(local >= 0, nodes[local], -1).astype(np.int32))
        return cls(vectors, above, links)

    def search(self, queries: np.ndarray, ef: int = EF) -> np.ndarray:
        """Numbers of up to ``ef`` near nodes of each query (-1 for none), nearest first."""
        n, count = len(self.vectors), len(queries)
        at = np.full(count, self.above[-1][0] if self.above else 0, np.int64)
        score = np.einsum("qd,qd->q", self.vectors[at], queries)
        for nodes, links in zip(self.above[::-1], self.links[:0:-1]):
            row = np.full(n, -1, np.int64)
            row[nodes] = np.arange(len(nodes))
            moving = np.arange(count)
            while len(moving):
                near = links[row[at[moving]]]
                sim = np.where(near >= 0, np.einsum("qmd,qd->qm", self.vectors[near], queries[moving]), -np.inf)
                best = sim.argmax(1)
                value = sim[np.arange(len(moving)), best]
                up = value > score[moving]
                at[moving[up]], score[moving[up]] = near[np.arange(len(moving)), best][up], value[up]
                moving = moving[up]
        ef = min(ef, n)
        ids, sims, done = np.full((count, ef), -1, np.int64), np.full((count, ef), -np.inf, np.float32), np.ones((count, ef), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = at, score, False
        seen = np.zeros(count * n, bool)
        stamp = np.zeros(count * n, np.int32)
        seen[np.arange(count) * n + at] = True
        active = np.arange(count)
        links = self.links[0]
        while len(active):
            waiting = np.where(done[active], -np.inf, sims[active])
            width = min(EXPAND, ef)
            top = np.argpartition(-waiting, width - 1, axis=1)[:, :width]
            live = np.take_along_axis(waiting, top, 1) > -np.inf
            has = live.any(1)
            active, top, live = active[has], top[has], live[has]
            if not len(active):
                break
            expand = np.where(live, np.take_along_axis(ids[active], top, 1), 0)
            now = done[active]
            np.put_along_axis(now, top, True, 1)
            done[active] = now
            near = np.where(live[:, :, None], links[expand], -1).reshape(len(active), -1)
            key = np.where(near >= 0, active[:, None] * n + near, 0)
            fresh = (near >= 0) & ~seen[key]
            q, c = np.nonzero(fresh)
            flat = key[q, c]
            order = np.arange(len(flat), dtype=np.int32)
            stamp[flat] = order
            single = stamp[flat] == order
            q, c, flat = q[single], c[single], flat[single]
            seen[flat] = True
            new = np.full(near.shape, -np.inf, np.float32)
            new[q, c] = np.einsum("nd,nd->n", self.vectors[near[q, c]], queries[active[q]])
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_sims = np.concatenate([sims[active], new], axis=1)
            all_done = np.concatenate([now, np.isneginf(new)], axis=1)
            keep = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids[active], sims[active], done[active] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_sims, all_done))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.where(np.take_along_axis(sims, order, 1) > -np.inf, np.take_along_axis(ids, order, 1), -1)


def scaled(x: np.ndarray, each: bool) -> np.ndarray:
    """Rows of ``x`` in single precision, divided by the largest norm (or each by its own), without overflow on the way."""
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True, initial=0)
    top = top if each else top.max(initial=0, keepdims=True)
    x = np.divide(x, top, out=np.zeros_like(x), where=top > 0)
    norm = np.sqrt((x**2).sum(1, keepdims=True))
    norm = norm if each else norm.max(initial=0, keepdims=True)
    return np.ascontiguousarray(np.divide(x, norm, out=np.zeros_like(x), where=norm > 0).astype(np.float32))


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def band(vector: Column) -> Column:
    """The number of the norm's band, by logarithms; equal norms are in the middle of theirs. Nothing overflows on the way."""
    top = F.array_max(F.transform(vector, lambda v: F.abs(v.cast("double"))))
    square = lambda m: F.aggregate(vector, F.lit(0.0), lambda a, v: a + (v / m) * (v / m))
    return F.round(F.get(F.transform(F.array(top), lambda m: F.log(m) + F.log(square(m)) / 2), F.lit(0)) / F.lit(float(np.log(BAND)))).cast("int")


def _vectors(rows: DataFrame, id_col: str, vector_col: str, name: str) -> DataFrame:
    """(name, vector) of rows that take part; single precision stays, any other kind is double."""
    kind = "float" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    return rows.select(F.col(id_col).cast("long").alias(name), F.col(vector_col).cast(f"array<{kind}>").alias("vector")).filter(F.col(name).isNotNull() & usable(F.col("vector")))


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index table: dim, shard, nodes' ids (flat, with their counts), vectors, and the graph's arrays; a row for each shard."""
    rows = _vectors(vectors, id_col, vector_col, "vec_id")
    kind = rows.schema["vector"].dataType.simpleString()
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    nodes = rows.withColumn("_rank", rank).filter(F.col("_rank") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = common.written(nodes.withColumn("dim", F.size("vector")).withColumn("band", band(F.col("vector"))), "nodes")
    counted = nodes.groupBy("dim", "band").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("shards"))
    earlier = F.sum("shards").over(Window.partitionBy("dim").orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    bands = common.written(counted.withColumn("first", F.coalesce(earlier, F.lit(0)).cast("int")), "bands")
    placed = nodes.join(F.broadcast(bands) if bands.count() <= BROADCAST_BANDS else bands, ["dim", "band"]).withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vector"), F.col("shards"))).cast("int"))
    flat_type = pa.list_(pa.float32() if kind == "array<float>" else pa.float64())

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim, shard = key[0].as_py(), key[1].as_py()
        found = sorted(zip(table["ids"].to_pylist(), range(table.num_rows)))
        order = np.array([i for _, i in found])
        flat = table["vector"].combine_chunks()
        x = flat.flatten().to_numpy().reshape(-1, dim)[order]
        graph = Graph.build(scaled(x, False))
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()),
            "counts": pa.array([[len(i) for i, _ in found]], pa.list_(pa.int32())), "ids": pa.array([[v for i, _ in found for v in i]], pa.list_(pa.int64())),
            "vectors": pa.array([x.ravel()], flat_type),
            "levels": pa.array([[len(a) for a in graph.above]], pa.list_(pa.int32())), "above": pa.array([np.concatenate([np.zeros(0, np.int32), *graph.above])], pa.list_(pa.int32())),
            "links": pa.array([np.concatenate([g.ravel() for g in graph.links])], pa.list_(pa.int32())),
        })

    schema = f"dim int, shard int, counts array<int>, ids array<long>, vectors {kind}, levels array<int>, above array<int>, links array<int>"
    index = common.written(placed.select("dim", "shard", "ids", "vector").groupBy("dim", "shard").applyInArrow(build, schema), "index")
    common.discard(nodes, bands)
    return index


def _answers(x: np.ndarray, graph: Graph, counts: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score: up to ``k`` candidates of each query in this shard."""
    near = graph.search(scaled(q, True), max(ef, 2 * k))
    row, place = np.nonzero(near >= 0)
    node = near[row, place]
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.einsum("nd,nd->n", x[node].astype(np.float64), q[row].astype(np.float64))
    begin = np.cumsum(counts) - counts
    count = counts[node].astype(np.int64)
    spot = np.repeat(begin[node] - np.cumsum(count) + count, count) + np.arange(count.sum())
    query, vec, score = np.repeat(query_ids[row], count), ids[spot], np.repeat(score, count)
    # Of the candidates with the query's own vector and vec_id one is the query's row.
    pair = np.repeat(np.arange(len(row)), count)
    own = np.flatnonzero((query == vec) & np.repeat((x[node] == q[row]).all(1), count))
    other = np.ones(len(query), bool)
    other[own[np.unique(pair[own], return_index=True)[1]]] = False
    query, vec, score = query[other], vec[other], score[other]
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    inside = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[inside], vec[inside], score[inside]


def search(index: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, ef: int = EF, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found."""
    asked = _vectors(queries, id_col, vector_col, "query_id").groupBy("query_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    asked = common.written(asked, "asked")
    blocks = max(1, -(-asked.count() // query_rows))
    parts = -(-blocks // PART_BLOCKS)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    blocked = asked.groupBy("dim", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("query_id", "vector"))).alias("asked"))
    ask = blocked.select("dim", "block", F.col("asked.query_id").alias("query_ids"), F.flatten("asked.vector").alias("query_vectors"))
    # Each block meets each shard of its dimension; a shard's graph comes first in each of its parts.
    numbers = index.groupBy("dim").agg(F.collect_list("shard").alias("_shards"))
    spread = ask.join(numbers, "dim").withColumn("shard", F.explode("_shards")).withColumn("part", F.col("block") % parts).drop("_shards")
    graphs = index.withColumn("block", F.lit(-1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    tasks = max(1, index.count() * parts)
    met = graphs.unionByName(spread, allowMissingColumns=True).repartition(tasks, "dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "block")
    arrays = ("counts", "ids", "vectors", "levels", "above", "links")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = graph = own = None
        for batch in batches:
            for r in range(batch.num_rows):
                value = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
                dim = value["dim"].as_py()
                if value["block"].as_py() < 0:
                    own = {n: value[n].values.to_numpy(zero_copy_only=False) for n in arrays}
                    x = own["vectors"].reshape(-1, dim)
                    n, sizes = len(x), own["levels"]
                    above = np.split(own["above"], np.cumsum(sizes)[:-1]) if len(sizes) else []
                    cuts = np.cumsum([n * M0, *(int(s) * M for s in sizes)])[:-1]
                    graph = Graph(scaled(x, False), above, [part.reshape(-1, M if i else M0) for i, part in enumerate(np.split(own["links"], cuts))])
                    continue
                ids, q = (value[n].values.to_numpy(zero_copy_only=False) for n in ("query_ids", "query_vectors"))
                found = _answers(x, graph, own["counts"], own["ids"], ids, q.reshape(-1, dim), k, ef)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    found = met.select("dim", "block", *arrays, "query_ids", "query_vectors").mapInArrow(look, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(build_index(vectors), vectors.filter("vec_id % 20 = 0"))
