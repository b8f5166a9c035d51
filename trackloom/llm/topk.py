"""Exact top-k search by inner product with one KD-tree per shard.

Vectors are dealt out by hash of their id into shards of about ``SHARD`` vectors.  A shard's tree splits at
the median of the widest dimension; every node has the tight box of its vectors.  For a query q the box
bounds the score by ``sum(max(q * low, q * high))``.  Nodes are opened best bound first, until no bound
reaches the kth score; a bound equal to it is opened, as a smaller id wins a tie.

Each query first searches the shard that holds it.  Its kth score there goes with it to all other shards,
where it is the bound from the start.  Queries meet shards in cells of a shard and a group of queries, so a
task holds one shard and at most about ``GROUP`` queries; a cell returns k rows per query at most.

Defined results: rows whose id or vector is null, or whose vector has a null or non-finite component, take
no part; scores must fit 64 bits; vectors meet those of equal length; of rows that share an id the smallest vector counts; a row
never meets its own id; ties go to the smaller id; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.words import table
from trackloom.plans.stages import stage

SHARD, GROUP, LEAF = 8_192, 4_096, 256


class Tree:
    """Boxes and children of the nodes; a leaf is a range of the reordered points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.child: list[tuple[int, int] | None] = []
        self.range: list[tuple[int, int]] = []
        self._grow(points, 0, len(points), leaf)
        self.points = points[self.order]
        self.low_, self.high_ = np.array(self.low), np.array(self.high)

    def _grow(self, points: np.ndarray, lo: int, hi: int, leaf: int) -> int:
        own = points[self.order[lo:hi]]
        node = len(self.child)
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.child.append(None)
        self.range.append((lo, hi))
        width = self.high[node] - self.low[node]
        if hi - lo > leaf and width.max() > 0:
            axis, middle = int(np.argmax(width)), (hi - lo) // 2
            part = np.argpartition(own[:, axis], middle)
            self.order[lo:hi] = self.order[lo:hi][part]
            self.child[node] = (self._grow(points, lo, lo + middle, leaf), self._grow(points, lo + middle, hi, leaf))
        return node

    def bounds(self, nodes: list[int], q: np.ndarray) -> np.ndarray:
        return np.maximum(self.low_[nodes] * q, self.high_[nodes] * q).sum(axis=1)


def search(tree: Tree, ids: np.ndarray, q: np.ndarray, own: int, k: int, at_least: float | None) -> list[tuple[int, int]]:
    """The best (score, id) of the shard, best first; none below ``at_least``, the kth score known so far."""
    found: list[tuple[int, int]] = []
    floor = -np.inf if at_least is None else at_least
    heap: list[tuple[float, int]] = [(-tree.bounds([0], q)[0], 0)]
    while heap:
        bound, node = heappop(heap)
        if -bound < floor:
            break
        children = tree.child[node]
        if children is not None:
            for b, c in zip(tree.bounds(list(children), q).tolist(), children):
                if b >= floor:
                    heappush(heap, (-b, c))
            continue
        lo, hi = tree.range[node]
        scores = tree.points[lo:hi] @ q
        for i in np.flatnonzero(scores >= floor):
            if ids[tree.order[lo + i]] != own:
                found.append((int(scores[i]), int(ids[tree.order[lo + i]])))
        if len(found) >= k:
            found.sort(key=lambda x: (-x[0], x[1]))
            del found[k:]
            floor = max(floor, found[-1][0])
    found.sort(key=lambda x: (-x[0], x[1]))
    return found


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of numbers that multiply and add without rounding."""
    flat = column.combine_chunks()
    flat = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = flat.reshape(len(column), -1)
    largest = float(np.abs(out).max()) if out.size else 0.0
    if largest * largest * max(1, out.shape[1]) < 2**52:
        return out.astype(np.float64)
    return out.astype(object)


def _distinct(ids: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Places of the vectors that count: for each id its smallest vector."""
    if len(np.unique(ids)) == len(ids):
        return np.arange(len(ids))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], tuple(points[i])))
    return np.array([i for n, i in enumerate(order) if n == 0 or ids[i] != ids[order[n - 1]]])


def scaled(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null unless all are finite numbers."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def exact_top_k(
    rows: DataFrame, is_query: Callable[[Column], Column], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other vectors of every row that ``is_query`` of the id picks."""
    points = rows.select(F.col(id_col).cast("long").alias("id"), scaled(vector_col, scale).alias("v")).dropna()
    points = points.withColumn("query", F.coalesce(is_query(F.col("id")), F.lit(False)))
    points = stage(points.withColumn("dim", F.size("v")), "vectors")
    count = points.agg(F.count("*").alias("n"), F.count_if("query").alias("q")).first()
    shards, groups = 1 + count.n // SHARD, 1 + count.q // GROUP
    points = points.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))

    def home(_: tuple, t: pa.Table) -> pa.Table:
        ids, v = t.column("id").to_numpy(), _matrix(t.column("v"))
        kept = _distinct(ids, v)
        ids, v, query = ids[kept], v[kept], t.column("query").to_numpy()[kept]
        tree = Tree(v)
        out = []
        for i in np.flatnonzero(query):
            best = search(tree, ids, v[i], int(ids[i]), k, None)
            out.append((int(ids[i]), v[i].astype(np.int64), best[-1][0] if len(best) == k else None, v.shape[1]))
        types = {"id": pa.int64(), "v": pa.list_(pa.int64()), "floor": pa.int64(), "dim": pa.int32()}
        return pa.Table.from_batches([table(dict(zip(types, map(list, zip(*out)))) if out else dict.fromkeys(types, []), types)])

    queries = points.groupBy("dim", "shard").applyInArrow(home, "id long, v array<long>, floor long, dim int")
    queries = stage(queries, "vector-queries")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = points.select("dim", "shard", "id", "v", every(groups).alias("group"))
    right = queries.withColumn("group", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups))).withColumn("shard", every(shards))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        types = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
        out: list[tuple[int, int, int]] = []
        if a.num_rows and b.num_rows:
            ids, v = a.column("id").to_numpy(), _matrix(a.column("v"))
            kept = _distinct(ids, v)
            ids, tree = ids[kept], Tree(v[kept])
            for own, q, floor in zip(b.column("id").to_pylist(), _matrix(b.column("v")), b.column("floor").to_pylist()):
                out += [(own, i, s) for s, i in search(tree, ids, q, own, k, floor)]
        return pa.Table.from_batches([table(dict(zip(types, map(list, zip(*out)))) if out else dict.fromkeys(types, []), types)])

    keys = ["dim", "shard", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
