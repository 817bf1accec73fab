"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by a hash of their id.  Each shard's graph is a few flat arrays of neighbours, one per layer, built by numpy a block of vectors at a time, and
stored as one row.  Every query walks every shard's graph; each shard's nearest are scored exactly and merged.

Inner products are made distances by one more component (so that all vectors are equally long).  Equal vectors of a shard are one node; their ids are told apart only in
the answers."""
from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.session import cut_lineage

SHARD_ROWS, LINKS, BUILD, SEARCH, K = 16_384, 16, 64, 96, 20
BLOCK = 256


class Graph(NamedTuple):
    """Nodes in order of falling layer; ``layers[l]`` holds the neighbours (-1: none) of the first ``len(layers[l])`` nodes in layer l."""
    points: np.ndarray               # float32, one component more than the vectors
    layers: list[np.ndarray]         # int32
    radius: float


def _layers_of(n: int, links: int) -> list[int]:
    """How many nodes reach each layer: a ``links``-th part of the one below."""
    sizes = [n]
    while sizes[-1] > 4 * links:
        sizes.append(max(links, sizes[-1] // links))
    return sizes


def _walk(points: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best nodes found for each query (falling nearness, -1: none) by best-first search from ``entries``; all queries advance together."""
    n, q = len(neighbours), len(queries)
    seen = np.zeros((q, n), bool)
    rows = np.arange(q)
    beam = np.full((q, width), -1, np.int32)
    near = np.full((q, width), -np.inf, np.float32)
    open_ = np.zeros((q, width), bool)
    e = min(entries.shape[1], width)
    beam[:, :e], open_[:, :e] = entries[:, :e], entries[:, :e] >= 0
    near[:, :e] = np.where(entries[:, :e] >= 0, np.einsum("qd,qed->qe", queries, points[np.maximum(entries[:, :e], 0)]), -np.inf)
    seen[rows[:, None], np.maximum(entries[:, :e], 0)] |= entries[:, :e] >= 0
    while len(rows):
        scores = np.where(open_[rows], near[rows], -np.inf)
        pick = scores.argmax(axis=1)
        going = scores[np.arange(len(rows)), pick] > -np.inf
        rows, pick = rows[going], pick[going]
        if not len(rows):
            break
        open_[rows, pick] = False
        next_ = neighbours[beam[rows, pick]]
        fresh = (next_ >= 0) & ~seen[rows[:, None], np.maximum(next_, 0)]
        r, c = np.nonzero(fresh)
        seen[rows[r], next_[r, c]] = True
        value = np.full(next_.shape, -np.inf, np.float32)
        value[r, c] = np.einsum("id,id->i", queries[rows[r]], points[next_[r, c]])
        value[value <= near[rows, -1][:, None]] = -np.inf
        better = (value > -np.inf).any(axis=1)
        if better.any():
            at = rows[better]
            every = np.concatenate((near[at], value[better]), axis=1)
            names = np.concatenate((beam[at], next_[better]), axis=1)
            unread = np.concatenate((open_[at], value[better] > -np.inf), axis=1)
            order = np.argsort(-every, axis=1, kind="stable")[:, :width]
            near[at], beam[at], open_[at] = (np.take_along_axis(x, order, 1) for x in (every, names, unread))
    return np.where(near > -np.inf, beam, -1), near


def _diverse(points: np.ndarray, base: np.ndarray, names: np.ndarray, near: np.ndarray, links: int) -> np.ndarray:
    """For each base point at most ``links`` of its candidates (sorted by falling nearness): first those nearer to it than to any taken before, then the nearest rest."""
    rows, width = names.shape
    held = points[np.maximum(names, 0)]
    between = held @ held.transpose(0, 2, 1)
    taken = np.zeros((rows, width), bool)
    for c in range(width):
        clash = (taken & (between[:, c, :] > near[:, c:c + 1])).any(axis=1)
        taken[:, c] = (names[:, c] >= 0) & ~clash & (taken.sum(axis=1) < links)
    rank = np.where(taken, 0, np.where(names >= 0, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :links]
    out = np.take_along_axis(names, order, 1)
    return out if out.shape[1] == links else np.pad(out, ((0, 0), (0, links - out.shape[1])), constant_values=-1)


def _layer(points: np.ndarray, n: int, degree: int, links: int, entries: np.ndarray | None, build: int) -> np.ndarray:
    """Neighbours of the first ``n`` nodes in one layer, inserted a block at a time; ``entries`` are where the layer above leads each to."""
    neighbours = np.full((n, degree), -1, np.int32)
    done = 0
    while done < n:
        size = min(n - done, BLOCK, max(2 * degree, done))
        new = np.arange(done, done + size)
        mine = points[new]
        among = mine @ mine.T
        np.fill_diagonal(among, -np.inf)
        few = min(size - 1, build)
        peers = np.argsort(-among, axis=1)[:, :few]
        names, near = done + peers, np.take_along_axis(among, peers, 1)
        if done:
            start = np.zeros((size, 1), np.int64) if entries is None else np.where(entries[new] < done, entries[new], 0)
            found, value = _walk(points, neighbours[:done], mine, start, build)
            names, near = np.concatenate((names, found), axis=1), np.concatenate((near, value), axis=1)
        order = np.argsort(-near, axis=1, kind="stable")[:, :build]
        names, near = np.take_along_axis(names, order, 1).astype(np.int32), np.take_along_axis(near, order, 1)
        chosen = _diverse(points, mine, names, near, links)
        neighbours[new, :links] = chosen
        # And back: every chosen node gets the new one, keeping the most useful of old and new.
        source, target = np.repeat(new, links), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        column = np.arange(len(target)) - np.repeat(first, count)
        for a in range(0, len(nodes), 1024):
            part = nodes[a:a + 1024]
            width = int(count[a:a + 1024].max())
            more = np.full((len(part), width), -1, np.int32)
            lo, hi = first[a], first[a + len(part) - 1] + count[a + len(part) - 1]
            more[np.repeat(np.arange(len(part)), count[a:a + 1024]), column[lo:hi]] = source[lo:hi]
            every = np.concatenate((neighbours[part], more), axis=1)
            value = np.where(every >= 0, np.einsum("nd,ncd->nc", points[part], points[np.maximum(every, 0)]), -np.inf)
            order = np.lexsort((every, -value), axis=1)
            every, value = np.take_along_axis(every, order, 1), np.take_along_axis(value, order, 1)
            twice = (every[:, 1:] == every[:, :-1]) & (every[:, 1:] >= 0)              # a peer may be there already
            every[:, 1:][twice] = -1
            full = (every >= 0).sum(axis=1) > degree
            out = np.full((len(part), degree), -1, np.int32)
            if full.any():
                out[full] = _diverse(points, points[part[full]], every[full][:, :2 * degree], value[full][:, :2 * degree], degree)
            keep = np.argsort(every[~full] < 0, axis=1, kind="stable")[:, :degree]
            kept = np.take_along_axis(every[~full], keep, 1)
            out[~full, :kept.shape[1]] = kept
            neighbours[part] = out
        done += size
    return neighbours


def build_graph(vectors: np.ndarray, links: int = LINKS, build: int = BUILD) -> Graph:
    """Graph over different vectors (rows)."""
    squares = np.einsum("nd,nd->n", vectors, vectors)
    radius = float(np.sqrt(squares.max(initial=0.0))) or 1.0
    points = np.concatenate((vectors / radius, np.sqrt(np.maximum(0, 1 - squares / radius**2))[:, None]), axis=1).astype(np.float32)
    sizes = _layers_of(len(points), links)
    layers: list[np.ndarray] = []
    entries = None
    for level in range(len(sizes) - 1, -1, -1):
        degree = 2 * links if level == 0 else links
        if layers:
            entries = _descend(points, layers, points[:sizes[level]])
        layers.insert(0, _layer(points, sizes[level], degree, links, entries, build))
    return Graph(points, layers, radius)


def _descend(points: np.ndarray, layers: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Where greedy walks through the layers (top last) lead each query."""
    out = np.zeros((len(queries), 1), np.int64)
    for neighbours in reversed(layers):
        for a in range(0, len(queries), 4 * BLOCK):
            out[a:a + 4 * BLOCK] = np.maximum(0, _walk(points, neighbours, queries[a:a + 4 * BLOCK], out[a:a + 4 * BLOCK], 4)[0][:, :1])
    return out


def search_graph(graph: Graph, queries: np.ndarray, width: int = SEARCH) -> np.ndarray:
    """Nodes near each query (a block of vectors), -1 for none."""
    points = np.concatenate((queries, np.zeros((len(queries), 1))), axis=1).astype(np.float32)
    entries = _descend(graph.points, graph.layers[1:], points) if len(graph.layers) > 1 else np.zeros((len(points), 1), np.int64)
    return _walk(graph.points, graph.layers[0], points, entries, min(width, len(graph.points)))[0]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: rows with an id and a vector without null or non-finite components that is not zero."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, links: int = LINKS, build: int = BUILD) -> DataFrame:
    """``shard, dim, ids, points, heads, layers, radius``: one row of flat arrays per shard of about ``shard_rows`` of ``vectors (vec_id, v)``.

    Vectors of another length than a shard's first fail; a shard is built in one task, so ``shard_rows`` bounds its memory and time."""
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")

    def build_one(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows["vec_id"].to_numpy()
        flat = rows["v"].combine_chunks().flatten().to_numpy()
        data = flat.reshape(len(ids), -1)
        order = np.lexsort((*data.T[::-1], ids))                                         # of rows that share an id the least vector stays
        order = order[np.flatnonzero(np.diff(ids[order], prepend=ids[order][:1] - 1))]
        ids, data = ids[order], data[order]
        _, first, node = np.unique(data.view(np.dtype((np.void, data.dtype.itemsize * data.shape[1]))).ravel(), return_index=True, return_inverse=True)
        shuffled = np.random.default_rng(11).permutation(len(first))                      # layers take nodes in this order
        place = np.empty(len(first), np.int64)
        place[shuffled] = np.arange(len(first))
        graph = build_graph(data[first[shuffled]], links, build)
        owner = place[node.ravel()]
        by_node = np.argsort(owner, kind="stable")                                       # ids of node i: heads[i] to heads[i + 1], ascending
        heads = np.searchsorted(owner[by_node], np.arange(len(first) + 1))
        columns = [[int(key[0].as_py())], [data.shape[1]], [ids[by_node].tobytes()], [heads.astype(np.int64).tobytes()], [data[first[shuffled]].tobytes()],
                   [graph.points.tobytes()], [[x.tobytes() for x in graph.layers]], [graph.radius]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.float64()))],
                        names=["shard", "dim", "ids", "heads", "vectors", "points", "layers", "radius"])
    return cut_lineage(dealt.groupBy("shard").applyInArrow(
        build_one, "shard int, dim int, ids binary, heads binary, vectors binary, points binary, layers array<binary>, radius double"))


def nearest(queries: DataFrame, graphs: DataFrame, k: int = K, width: int = SEARCH, links: int = LINKS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query of ``queries (vec_id, v)``, itself left out; ties go to the smaller id.

    Queries are dealt to all shards and pass each graph in blocks; a shard answers ``k`` rows per query."""
    shards = [r["shard"] for r in graphs.select("shard").collect()]                      # a number per shard
    asked = queries.select(F.explode(F.array(*map(F.lit, shards)) if shards else F.array().cast("array<int>")).alias("shard"), F.col("vec_id").alias("query_id"), "v")
    empty = {c: F.lit(None).cast(t) for c, t in graphs.dtypes if c != "shard"}
    both = graphs.withColumns({"query_id": F.lit(None).cast("long"), "v": F.lit(None).cast("array<double>")}).unionByName(asked.withColumns(empty))
    both = both.repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", F.col("query_id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            for a, b in zip(*(lambda c: ([0, *c], [*c, len(shard)]))((np.flatnonzero(np.diff(shard)) + 1).tolist())):
                part = batch.slice(a, b - a)
                if part.column("query_id")[0].as_py() is None:
                    row = part.slice(0, 1).to_pylist()[0]
                    points = np.frombuffer(row["points"], np.float32).reshape(-1, row["dim"] + 1)
                    layers = [np.frombuffer(x, np.int32).reshape(-1, links * (2 if i == 0 else 1)) for i, x in enumerate(row["layers"])]
                    held = (Graph(points, layers, row["radius"]), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["heads"], np.int64),
                            np.frombuffer(row["vectors"], np.float64).reshape(len(points), -1))
                    part = part.slice(1)
                if part.num_rows:
                    yield from _answers(held, part, k, width)

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(held: tuple, part: pa.RecordBatch, k: int, width: int) -> Iterator[pa.RecordBatch]:
    graph, ids, heads, vectors = held
    query_ids = part.column("query_id").to_numpy()
    queries = part.column("v").flatten().to_numpy().reshape(len(query_ids), -1)
    for a in range(0, len(queries), BLOCK):
        block = queries[a:a + BLOCK]
        nodes = search_graph(graph, block / np.linalg.norm(block, axis=1, keepdims=True), max(width, k + 1))
        names, found, scores = [], [], []
        for query_id, query, near in zip(query_ids[a:a + BLOCK].tolist(), block, nodes):
            near = near[near >= 0]
            exact = vectors[near] @ query
            # The k + 1 smallest ids of each node are enough: one may be the query's own.
            lists = [ids[heads[x]:min(heads[x + 1], heads[x] + k + 1)] for x in near]
            every = np.concatenate(lists) if lists else np.empty(0, np.int64)
            value = np.repeat(exact, [len(x) for x in lists])
            value, every = value[every != query_id], every[every != query_id]
            best = np.lexsort((every, -value))[:k]
            names += [query_id] * len(best)
            found.append(every[best])
            scores.append(value[best])
        yield pa.record_batch([pa.array(names, pa.int64()), pa.array(np.concatenate(found)), pa.array(np.concatenate(scores))], names=["query_id", "vec_id", "score"])


def search_every(vectors: DataFrame, step: int = 20, k: int = K, **kinds: int) -> DataFrame:
    """Neighbours of every row of ``vectors (vec_id, embedding, ...)`` whose id is divisible by ``step`` among all rows.

    Vectors that are null, zero or hold null or non-finite components take no part; a query without other vectors has no row; of rows that share an id
    the one with the least vector counts."""
    rows = usable(vectors)
    queries = rows.where(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return nearest(queries, index(rows, **kinds), k)
