"""Similarity join of documents on word n-grams, with Bayesian pruning of candidates.

Words are ``words.ALNUM``; a document's set are its windows of ``n`` words (all its words, if it has fewer
but not none).  Documents with equal sets are one class.  Each class gets ``HASHES`` MinHash values;
classes that share a band are compared ``STEP`` values at a time: with m equal values of n, the posterior of
the similarity under a uniform prior is Beta(m + 1, n - m + 1), and a pair is dropped once the posterior
probability of reaching the threshold falls below ``TOLERANCE``.  Classes connected by surviving pairs are
compared exactly, set against set, in blocks within tasks; a task returns one row per class, with its
number of links, never the pairs.

Defined results: null ids take no part (their rows have no class and 0 links); a text without words has no
links and is a class of its own; rows with equal sets, repeated rows among them, count as links of each
other; only id and text of the input are used, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import bloom
from trackloom.llm.groups import (
    BLOCK,
    U,
    band_hashes,
    cells,
    components,
    in_cells,
    k64_of,
    keys_of,
    min_hashes,
    pack,
    roots,
    shards_for,
    similar,
)
from trackloom.llm.words import ALNUM, Words, give_back, mix, slices, table, utf8, windows, words_of
from trackloom.plans.stages import stage

NGRAM, THRESHOLD = 5, 0.8
#: 25 bands of 4 rows meet a pair at the threshold with probability 1 - 2e-6.
BANDS, ROWS = 25, 4
HASHES, STEP, TOLERANCE = 128, 16, 1e-6


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of values compared, the least number of equal ones that a pair must have to go on.

    P(J >= t | m of n) is the chance that at most m of n + 1 draws succeed with probability t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        below = np.cumsum([comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(n + 1)])
        out[n] = int(np.searchsorted(below, tolerance))
    return out


def surviving(sig: np.ndarray, side: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs of a cell keep a posterior chance of reaching the threshold."""
    n = len(sig)
    alive = (side[:, None] != side[None, :]) if side.any() else ~np.eye(n, dtype=bool)
    i, j = np.nonzero(np.triu(alive))
    equal = np.zeros(len(i), np.int32)
    for upto, least in least_matches(threshold, tolerance).items():
        equal += (sig[i, upto - STEP : upto] == sig[j, upto - STEP : upto]).sum(axis=1, dtype=np.int32)
        on = equal >= least
        i, j, equal = i[on], j[on], equal[on]
    out = np.zeros((n, n), bool)
    out[i, j] = out[j, i] = True
    return out


def sets_of(w: Words, n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sorted distinct window hashes of each document, and two hashes of the set (0 for an empty one)."""
    at, _, h, _ = windows(w, n, whole_short=True)
    bounds = np.searchsorted(at, w.first).tolist()
    sets, k1, k2 = [], np.zeros(len(bounds) - 1, U), np.zeros(len(bounds) - 1, U)
    m1, m2 = mix(h, 41), mix(h, 42)
    for d, (i, j) in enumerate(zip(bounds, bounds[1:])):
        if i == j:
            sets.append(h[:0])
            continue
        order = np.argsort(h[i:j])
        s = h[i:j][order]
        fresh = np.empty(j - i, bool)
        fresh[0] = True
        np.not_equal(s[1:], s[:-1], out=fresh[1:])
        kept = order[fresh]
        sets.append(s[fresh])
        k1[d], k2[d] = m1[i:j][kept].sum() + U(len(kept)), m2[i:j][kept].sum()
    return sets, mix(k1, 43), mix(k2, 44)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")


def _signed(rows: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, sig) of documents with words; within a piece only the first of a class has its values."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets, k1, k2 = sets_of(words_of(*utf8(b.column("text")), ALNUM), n)
            full = np.flatnonzero([len(s) > 0 for s in sets])
            if not len(full):
                continue
            keys = keys_of(k1[full], k2[full])
            first = np.zeros(len(full), bool)
            first[np.unique(np.array(keys, "V16"), return_index=True)[1]] = True
            lead = [sets[d] for d in full[first]]
            ends = np.cumsum([len(s) for s in lead])
            starts = ends - [len(s) for s in lead]
            sig: list[bytes | None] = [None] * len(full)
            for i, row in zip(np.flatnonzero(first), min_hashes((np.concatenate(lead) >> U(32)).astype(np.uint32), starts, ends, HASHES)):
                sig[i] = row.tobytes()
            yield table({"doc_id": b.column("doc_id").take(pa.array(full)), "key": keys, "sig": sig}, types)

    types = {"doc_id": pa.int64(), "key": pa.binary(), "sig": pa.binary()}
    return rows.mapInArrow(scan, "doc_id long, key binary, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def _packed(signed: DataFrame, shards: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(pack(k64_of(b.column("key")), band_hashes(_matrix(b.column("sig")), BANDS, ROWS), shards))
            yield table({"shard": [r[0] for r in rows], "hashes": [r[1] for r in rows], "items": [r[2] for r in rows]}, types)
        give_back()

    types = {"shard": pa.int32(), "hashes": pa.binary(), "items": pa.binary()}
    return signed.select("key", "sig").where("sig IS NOT NULL").mapInArrow(scan, "shard int, hashes binary, items binary")


def _k64(key: str = "key"):
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def _stars(keys: list[bytes], linked: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """One link from each item to the first item it is connected with."""
    root = roots(linked)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return [keys[i] for i in moved], [keys[root[i]] for i in moved]


def similar_documents(
    docs: DataFrame,
    n: int = NGRAM,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_key: bool = False,
) -> DataFrame:
    """One row per document: ``class_id``, the smallest id of those connected with it by links; ``copy_id``,
    the smallest id of those with the same set; ``n_links``, the documents of at least the threshold."""
    rows = _documents(docs, id_col, text_col)
    signed = stage(_signed(rows, n), "ngram-signed")
    classes = stage(signed.groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("size")), "ngram-classes")

    found = stage(cells(_packed(signed, shards_for(docs.count(), 20_000))), "ngram-cells")
    wanted = found.select("k64").distinct()
    values = signed.select("key", "sig").where("sig IS NOT NULL").withColumn("k64", _k64())
    values = values.join(wanted, "k64", "left_semi").groupBy("key", "k64").agg(F.first("sig").alias("sig"))
    links = in_cells(found.join(values, "k64"), _prune(threshold, tolerance), "a binary, b binary")
    # The links of an item come together first; the union-find is then no second Python step of the same tasks.
    links = links.repartition(F.greatest("a", "b"))
    clusters = stage(components(links, "ngram-candidates"), "ngram-clusters")

    joined = stage(_verified(rows, clusters, classes, n, threshold), "ngram-links")
    connected = components(joined.select(F.col("key").alias("a"), F.col("root").alias("b")), "ngram-components")
    linked = joined.groupBy("key").agg(F.sum("links").alias("links"))
    per_class = classes.join(linked, "key", "left").join(connected, "key", "left").withColumn("root", F.coalesce("root", "key"))
    # Only classes with links can share a root; the others are their own.
    smallest = per_class.where("links > 0").groupBy("root").agg(F.min("copy_id").alias("class_id"))
    per_class = per_class.join(smallest, "root", "left").select(
        "key",
        F.coalesce("class_id", "copy_id").alias("class_id"),
        "copy_id",
        (F.col("size") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )
    extra = ["key"] if with_key else []
    out = signed.select("doc_id", "key").join(per_class, "key").select("doc_id", "class_id", "copy_id", "n_links", *extra)
    null_key = [F.lit(None).cast("binary").alias("key")] if with_key else []
    alone = _without_set(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return out.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), *null_key))


def _without_set(rows: DataFrame) -> DataFrame:
    """Documents without an id or without a word."""
    wordless = F.coalesce(~F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(True))
    return rows.where(F.col("doc_id").isNull() | wordless)


def _prune(threshold: float, tolerance: float):
    def run(b: pa.RecordBatch, bounds: list[int]) -> pa.RecordBatch:
        keys, sig, side = b.column("key").to_pylist(), _matrix(b.column("sig")), b.column("side").to_numpy()
        first, second = [], []
        for i, j in zip(bounds, bounds[1:]):
            x, y = _stars(keys[i:j], surviving(sig[i:j], side[i:j], threshold, tolerance))
            first += x
            second += y
        return table({"a": first, "b": second}, {"a": pa.binary(), "b": pa.binary()})

    return run


def _sets(rows: DataFrame, bits: np.ndarray, n: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets, k1, k2 = sets_of(words_of(*utf8(b.column("text")), ALNUM), n)
            wanted = np.flatnonzero(bloom.may_hold(shared.value, k1.view(np.int64)) & np.array([len(s) > 0 for s in sets], bool))
            wanted = wanted[np.unique(k1[wanted], return_index=True)[1]]
            yield table({"key": keys_of(k1[wanted], k2[wanted]), "items": [sets[d].tobytes() for d in wanted]}, types)

    types = {"key": pa.binary(), "items": pa.binary()}
    return rows.select("text").mapInArrow(scan, "key binary, items binary")


def _verified(rows: DataFrame, clusters: DataFrame, classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(key, links, root) for each class and cell: links to other classes of the cluster, and whom it hangs on."""
    bits = bloom.bit_map(clusters.select(_k64()))
    blocks = F.ceil(F.col("members") / BLOCK)
    sized = clusters.join(clusters.groupBy("root").agg(F.count("*").alias("members")), "root").join(classes, "key")
    sets = _sets(rows, bits, n).groupBy("key").agg(F.first("items").alias("items"))
    members = sized.join(sets, "key").withColumn("own", F.pmod(F.xxhash64("key"), blocks))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    spread = spread.select(F.xxhash64("root", low, high).alias("cell"), "key", "size", "items", F.when(F.col("own") > F.col("other"), 1).otherwise(0).cast("byte").alias("side"))

    def run(b: pa.RecordBatch, bounds: list[int]) -> pa.RecordBatch:
        side, size, keys = b.column("side").to_numpy(), b.column("size").to_numpy(), b.column("key").to_pylist()
        sets = [np.frombuffer(x, U) for x in b.column("items").to_pylist()]
        links, root = [], []
        for i, j in zip(bounds, bounds[1:]):
            linked = similar(sets[i:j], threshold)
            if side[i:j].any():
                linked &= side[i:j, None] != side[None, i:j]
            links += (linked @ size[i:j]).tolist()
            root += [keys[i + k] for k in roots(linked)]
        return table({"key": keys, "links": links, "root": root}, {"key": pa.binary(), "links": pa.int64(), "root": pa.binary()})

    return in_cells(spread, run, "key binary, links long, root binary").where("links > 0")


def keep_one(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with one document of each connected group: that with the smallest id.

    Documents without an id or without words stay.  Of rows that repeat the id and the set of the kept
    document, one stays.  Only documents with links can go, and only their texts are shuffled.
    """
    found = stage(similar_documents(docs, n, threshold, id_col=id_col, text_col=text_col, with_key=True).where("n_links > 0"), "ngram-found")
    bits = bloom.bit_map(found.select("doc_id"))
    _, clear = bloom.split(docs, id_col, bits)
    # The row's own names can't clash with those added here: they are the only ones of a struct.
    keyed = _with_key(docs, n, id_col, text_col, bits)
    lead = found.where("doc_id = class_id").select("doc_id", "key").distinct().withColumn("lead", F.lit(True))
    known = found.select("doc_id", "key").distinct().withColumn("known", F.lit(True))
    pair = [keyed["row"][id_col].cast("long").alias("doc_id"), "key", "row"]
    rows = keyed.select(*pair).join(known, ["doc_id", "key"], "left").join(lead, ["doc_id", "key"], "left")
    free = rows.where("known IS NULL").select("row.*")
    first = rows.where("lead").groupBy("doc_id", "key").agg(F.first("row").alias("row")).select("row.*")
    return clear.unionByName(free).unionByName(first)


def _with_key(docs: DataFrame, n: int, id_col: str, text_col: str, bits: np.ndarray) -> DataFrame:
    """(key, row) of rows whose id may be in the map: the key of the row's set (null for an empty one) and the whole row."""
    shared, at = docs.sparkSession.sparkContext.broadcast(bits), docs.columns.index(id_col)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (b.filter(pa.array(bloom.inside(b.column("row").flatten()[at], shared.value))) for b in batches)
        for b in slices(some, "text"):
            sets, k1, k2 = sets_of(words_of(*utf8(b.column("text")), ALNUM), n)
            keys = [k if len(s) else None for k, s in zip(keys_of(k1, k2), sets)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column("row")], names=["key", "row"])

    schema = row.select(F.lit(b"").cast("binary").alias("key"), "row").schema
    return row.mapInArrow(scan, schema)
