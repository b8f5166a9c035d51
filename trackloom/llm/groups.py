"""Candidate groups, exact overlaps and connected components of many small sets.

Items are named by a 16-byte ``key``; ``k64`` are its first eight bytes.  Band hashes are dealt out in
packed arrays (a few rows per task and shard), sorted inside the shard, and leave as cells: lists of
items to be compared with one another.  A large bucket becomes one cell for each pair of its blocks, so
no task holds a whole bucket's items, and no pair of items is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import U, give_back, mix, table
from trackloom.plans.stages import stage

BLOCK = 512


def keys_of(h1: np.ndarray, h2: np.ndarray) -> list[bytes]:
    both = np.empty((len(h1), 2), ">u8")
    both[:, 0], both[:, 1] = h1, h2
    raw = both.tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def k64_of(keys: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), ">u8")[::2].astype(np.int64) if len(keys) else np.zeros(0, np.int64)


def seeds(k: int) -> np.ndarray:
    return (mix(np.arange(k, dtype=U), 11) >> U(32)).astype(np.uint32) | np.uint32(1)


def min_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """``k`` MinHash values of the stretches of ``x`` (well mixed 32-bit hashes) from ``starts`` to ``ends``.

    Stretches are in order, don't overlap, and none is empty.  The permutations are products with odd numbers.
    """
    out = np.empty((len(starts), k), np.uint32)
    if not len(starts):
        return out
    odd = seeds(k)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 32768, "right")))
        y = x[starts[lo] : ends[hi - 1]]
        # Every other range is the gap after a stretch; its value is left out.
        at = np.stack([starts[lo:hi], ends[lo:hi]], axis=1).ravel()[:-1] - starts[lo]
        joined = bool((starts[lo + 1 : hi] == ends[lo : hi - 1]).all())
        at = at[::2] if joined else at
        v = np.empty_like(y)
        for j in range(k):
            np.multiply(y, odd[j], out=v)
            least = np.minimum.reduceat(v, at)
            out[lo:hi, j] = least if joined else least[::2]
        lo = hi
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), U)
    factors = mix(np.arange(rows, dtype=U), 12) | U(1)
    for i in range(bands):
        h = np.full(len(sig), U(i + 1))
        for j in range(rows):
            h += (sig[:, i * rows + j].astype(U) + U(1)) * factors[j]
        out[:, i] = mix(h, i)
    return out


def shards_for(rows: int, each: int) -> int:
    """Number of shards so that one holds the band hashes of about ``each`` rows."""
    return max(256, rows // each)


def pack(k64: np.ndarray, bands: np.ndarray, shards: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Rows (shard, band hashes, items) for the distinct items given.

    Inside a shard 32 bits of the hash are left; a chance meeting is only one more comparison.
    """
    h, k = bands.ravel(), np.repeat(k64, bands.shape[1])
    shard = ((h >> U(32)) % U(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    h, k, shard = h[order].astype(np.uint32), k[order], shard[order]
    cuts = np.flatnonzero(np.diff(shard)) + 1
    bounds = [0, *cuts.tolist(), len(h)] if len(h) else []
    for i, j in zip(bounds, bounds[1:]):
        yield int(shard[i]), h[i:j].tobytes(), k[i:j].tobytes()


def cells(packed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (cell, k64, side) of items that share a band hash; both sides are 0 inside one block.

    ``packed``: (shard int, hashes binary, items binary).  Buckets with the same items are one cell.
    """

    def buckets(_: tuple, t: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(t.column(name).to_pylist()), kind)
        h, k = join("hashes", np.uint32), join("items", np.int64)
        order = np.lexsort((k, h))
        h, k = h[order], k[order]
        fresh = np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])) if len(h) else np.zeros(0, bool)
        h, k = h[fresh], k[fresh]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(h)))
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(starts):
            m = mix(k.view(U), 21)
            sums = np.append(U(0), np.cumsum(m))
            name = mix(sums[starts + sizes] - sums[starts] + sizes.astype(U), 22)
            small = sizes <= block
            first = np.unique(name[small], return_index=True)[1]
            s, z, c = starts[small][first], sizes[small][first], name[small][first]
            at = np.repeat(s - (np.cumsum(z) - z), z) + np.arange(int(z.sum()))
            out.append((np.repeat(c, z), k[at], np.zeros(len(at), np.int8)))
            for lo, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
                parts = [slice(i, min(i + block, lo + n)) for i in range(lo, lo + n, block)]
                names = mix(np.array([m[p].sum() for p in parts]), 23)
                for i, p in enumerate(parts):
                    out.append((np.full(p.stop - p.start, names[i]), k[p], np.zeros(p.stop - p.start, np.int8)))
                    for j in range(i + 1, len(parts)):
                        q = parts[j]
                        cell = mix(names[i : i + 1] * U(3) + names[j : j + 1], 24)[0]
                        out.append((np.full(p.stop - p.start + q.stop - q.start, cell), np.append(k[p], k[q]), np.repeat(np.array([0, 1], np.int8), [p.stop - p.start, q.stop - q.start])))
        cat = lambda i, kind: np.concatenate([o[i] for o in out]) if out else np.zeros(0, kind)
        return pa.table({"cell": cat(0, U).view(np.int64), "k64": cat(1, np.int64), "side": cat(2, np.int8)})

    return packed.groupBy("shard").applyInArrow(buckets, "cell long, k64 long, side byte").distinct()


def in_cells(rows: DataFrame, fn: Callable[[pa.RecordBatch, list[int]], pa.RecordBatch], schema: str, piece: int = 4 << 20) -> DataFrame:
    """``fn`` over runs of whole cells of about ``piece`` bytes: their rows, and where each cell begins and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            if held and held[-1].column("cell")[-1].as_py() == b.column("cell")[0].as_py() and b.column("cell")[0] == b.column("cell")[-1]:
                held.append(b)  # the cell may go on
                continue
            whole = _joined([*held, b])
            last = _bounds(whole)[-2]
            if last:
                yield from _pieces(whole.slice(0, last), fn, piece)
            held = [whole.slice(last)]
            give_back()
        if held:
            yield from _pieces(_joined(held), fn, piece)
        give_back()

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _bounds(b: pa.RecordBatch) -> list[int]:
    v = b.column("cell").to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), b.num_rows]


def _pieces(b: pa.RecordBatch, fn: Callable[[pa.RecordBatch, list[int]], pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    bounds = _bounds(b)
    each = max(1, piece * b.num_rows // max(1, b.nbytes))  # rows of a piece, about
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + each, "right")) - 1)
        found = fn(b.slice(bounds[lo], bounds[hi] - bounds[lo]), [x - bounds[lo] for x in bounds[lo : hi + 1]])
        if found.num_rows:
            yield found
        lo = hi


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of distinct 64-bit numbers, as a matrix (0 on the diagonal)."""
    n = len(sets)
    out = np.zeros((n, n), np.int64)
    if n == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(values)))
    column = np.repeat(np.cumsum(counts > 1) - 1, counts)
    shared = np.repeat(counts > 1, counts)
    owner, column = owner[shared], column[shared]
    width = int(column[-1]) + 1 if len(column) else 0
    cuts = np.searchsorted(column, np.arange(0, width + 4096, 4096))
    for c, (i, j) in enumerate(zip(cuts, cuts[1:])):
        dense = np.zeros((n, 4096), np.float32)
        dense[owner[i:j], column[i:j] - c * 4096] = 1
        out += (dense @ dense.T).astype(np.int64)
    np.fill_diagonal(out, 0)
    return out


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of ``threshold`` or more, in exact arithmetic."""
    t = Fraction(str(threshold))
    size = np.array([len(s) for s in sets], np.int64)
    met = overlaps(sets)
    out = (met * (t.denominator + t.numerator) >= t.numerator * (size[:, None] + size[None, :])) & (met > 0)
    np.fill_diagonal(out, False)
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """For each item the smallest item that it is connected with, given a symmetric matrix of links."""
    n = len(linked)
    label = np.arange(n)
    if not linked.any():
        return label
    while True:
        near = np.where(linked, label[None, :], n).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, name: str) -> DataFrame:
    """(key, root) of every key in ``edges`` (a, b): root is the smallest key of its component.

    Each task first runs union-find over the links it holds and passes on one link per key; then each
    key's larger neighbours and its smaller neighbours are linked to the smallest one in turn, until
    nothing changes.  Every round is a stored table; only its number of rows and a checksum are read.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for b in batches:
            for x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        stars = [(x, find(x)) for x in parent]
        stars = [(x, y) for x, y in stars if x != y]
        yield table({"u": [x for x, _ in stars], "v": [y for _, y in stars]}, {"u": pa.binary(), "v": pa.binary()})

    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    links = stage(links.mapInArrow(contract, "u binary, v binary").distinct(), name)
    state = None
    while True:
        new = (links.count(), links.agg(F.bit_xor(F.xxhash64("u", "v"))).first()[0])
        if new == state or new[0] == 0:
            return links.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()
            )
        state = new
        links = stage(_to_smallest(_to_smallest(links, True), False), name)


def _to_smallest(links: DataFrame, larger: bool) -> DataFrame:
    """Link each key's larger neighbours (or its smaller ones and itself) to its smallest neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = (both.where("v > u") if larger else both).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()
