"""Benchmark decontamination: documents are scanned for word windows of benchmark items.

Words are runs of letters and digits (``words.ALNUM``: A-Z count as a-z, every non-ASCII character
belongs to a word).  A window is ``n`` consecutive words of an item; an item of fewer words, but not
none, is one window.  A document word inside any occurrence of a window is hit.

The windows of the benchmark are a sorted hash set that is broadcast to the tasks.  Their number is
counted first: beyond ``most`` of them the windows of both sides are joined by hash instead.  Every
hash hit of the broadcast set is verified against the window's words; the join uses both 64-bit hashes.

Defined results: a null text has no words; benchmark rows whose id or text is null take no part;
equal items, equal ids and repeated documents are allowed (a document row is judged on its own);
an empty benchmark hits nothing.  ``contamination`` keeps only the id of the input, so other columns
can't clash; ``decontaminate`` returns the input's columns unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import ALNUM, U, Words, covered, slices, table, utf8, windows, words_of
from trackloom.plans.stages import stage

WINDOW = 13
#: Windows that are broadcast at most (about 200 bytes each).
MOST_BROADCAST = 200_000
_WINDOW_TYPES = {"n": pa.int32(), "h1": pa.int64(), "h2": pa.int64(), "item": pa.int64(), "gram": pa.binary()}


@dataclass
class Index:
    """Benchmark windows by length, sorted by hash; ``items[k]`` are the ids that hold window k."""

    lengths: list[int]
    hashes: dict[int, np.ndarray]
    grams: dict[int, list[bytes]]
    items: dict[int, list[list[int]]]


def benchmark_windows(bench: DataFrame, n: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct window of an item: its length, both hashes, the item and the words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words_of(*utf8(b.column("text")), ALNUM)
            at, end, h1, h2 = windows(w, n, whole_short=True)
            owner = np.searchsorted(w.first, at, "right") - 1
            item = b.column("item").to_numpy(zero_copy_only=False)[owner]
            grams = [w.text(i, j) for i, j in zip(at, end)]
            yield table({"n": (end - at).astype(np.int32), "h1": h1.view(np.int64), "h2": h2.view(np.int64), "item": item, "gram": grams}, _WINDOW_TYPES)

    rows = bench.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).dropna()
    return rows.mapInArrow(scan, "n int, h1 long, h2 long, item long, gram binary").distinct()


def index_of(rows: list) -> Index:
    by: dict[int, dict[int, tuple[bytes, list[int]]]] = {}
    for r in rows:
        by.setdefault(r.n, {}).setdefault(r.h1 & 0xFFFFFFFFFFFFFFFF, (bytes(r.gram), []))[1].append(r.item)
    out = Index(sorted(by), {}, {}, {})
    for n, found in by.items():
        keys = sorted(found)
        out.hashes[n] = np.array(keys, U)
        out.grams[n] = [found[k][0] for k in keys]
        out.items[n] = [sorted(found[k][1]) for k in keys]
    return out


def hits(w: Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end word of each verified occurrence, the window's length and its place in the index."""
    found: list[tuple[int, int, int, int]] = []
    for n in index.lengths:
        keys = index.hashes[n]
        at, end, h, _ = windows(w, n)
        place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        for k in np.flatnonzero(keys[place] == h):
            i, j, p = int(at[k]), int(end[k]), int(place[k])
            if _fold(w.text(i, j)) == _fold(index.grams[n][p]):
                found.append((i, j, n, p))
    return tuple(np.array(found, np.int64).reshape(-1, 4).T)


_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _fold(words: bytes) -> bytes:
    return words.translate(_FOLD)


def _judge(w: Words, index: Index) -> tuple[np.ndarray, list[list[int]], np.ndarray, np.ndarray]:
    """Hit words and items of every document; the hit mask and the owner of every word."""
    docs = len(w.first) - 1
    i, j, n, p = hits(w, index)
    mask = covered(len(w.start), i, j)
    owner = np.repeat(np.arange(docs), np.diff(w.first))
    items: list[set[int]] = [set() for _ in range(docs)]
    for d, n_, p_ in zip((np.searchsorted(w.first, i, "right") - 1).tolist(), n.tolist(), p.tolist()):
        items[d].update(index.items[n_][p_])
    return np.bincount(owner[mask], minlength=docs), [sorted(x) for x in items], mask, owner


def _is_contaminated(n_hit: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return (n_hit > 0) & (20 * n_hit >= n_words)


_REPORT = "doc_id long, n_words long, n_hit long, items array<long>, contaminated boolean"


def contamination(
    docs: DataFrame, bench: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BROADCAST
) -> DataFrame:
    """One row per document: words, hit words, sorted ids of the items with occurring windows, verdict."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stage(benchmark_windows(bench, n), "benchmark-windows")
    if found.count() > most:
        return _by_join(rows, found)
    index = docs.sparkSession.sparkContext.broadcast(index_of(found.collect()))
    types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.int64()), "contaminated": pa.bool_()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words_of(*utf8(b.column("text")), ALNUM)
            n_hit, items, _, _ = _judge(w, index.value)
            n_words = np.diff(w.first)
            yield table({"doc_id": b.column("doc_id"), "n_words": n_words, "n_hit": n_hit, "items": items, "contaminated": _is_contaminated(n_hit, n_words)}, types)

    return rows.mapInArrow(scan, _REPORT)


def _met(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, at, n, item): places of texts that hold a window of ``found``; ``key`` names the text.

    Windows are joined by both of their 64-bit hashes.  The key is the 128-bit digest of the text, so rows
    with one text are looked at once and different texts are not mixed up, however many there are.
    """
    lengths = [r.n for r in found.select("n").distinct().collect()]  # at most the window's length
    types = {"key": pa.binary(), "n": pa.int32(), "at": pa.int64(), "h1": pa.int64(), "h2": pa.int64()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words_of(*utf8(b.column("text")), ALNUM)
            for n in lengths:
                at, end, h1, h2 = windows(w, n)
                owner = np.searchsorted(w.first, at, "right") - 1
                local = at - w.first[owner]
                keys = b.column("key").take(pa.array(owner))
                yield table({"key": keys, "n": np.full(len(at), n, np.int32), "at": local, "h1": h1.view(np.int64), "h2": h2.view(np.int64)}, types)

    texts = rows.where("text IS NOT NULL").dropDuplicates(["key"]).select("key", "text")
    spans = texts.mapInArrow(scan, "key binary, n int, at long, h1 long, h2 long")
    return spans.join(found.select("n", "h1", "h2", "item"), ["n", "h1", "h2"]).select("key", "at", "n", "item")


def _text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.col(text_col).cast("binary")))


def _by_join(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The same report when the benchmark is too large to broadcast: windows are joined by hash."""
    keyed = rows.withColumn("key", _text_key("text"))
    met = stage(_met(keyed, found), "benchmark-met")
    # A window's words as a set per document: bounded by the document, so one row may hold them.
    words = met.select("key", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("word")).distinct()
    hit = words.groupBy("key").agg(F.count("*").alias("n_hit"))
    items = met.select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words_of(*utf8(b.column("text")), ALNUM)
            yield table({"doc_id": b.column("doc_id"), "key": b.column("key"), "n_words": np.diff(w.first)}, sizes)

    sizes = {"doc_id": pa.int64(), "key": pa.binary(), "n_words": pa.int64()}
    counted = keyed.mapInArrow(count, "doc_id long, key binary, n_words long")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return counted.join(hit, "key", "left").join(items, "key", "left").select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame, bench: DataFrame, n: int = WINDOW, remove: str = "documents", text_col: str = "text", most: int = MOST_BROADCAST
) -> DataFrame:
    """The input without contaminated documents, or (``remove='spans'``) with their hit stretches cut out.

    A stretch is cut from its first to its last byte; what stands around it stays as it is.  Up to ``most``
    windows are broadcast; those of a larger benchmark are joined with the windows of the texts.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove: 'documents' or 'spans'")
    found = stage(benchmark_windows(bench, n), "benchmark-windows")
    if found.count() > most:
        return _decontaminate_by_join(docs, found, remove, text_col)
    index = docs.sparkSession.sparkContext.broadcast(index_of(found.collect()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            w = words_of(*utf8(b.column(text_col)), ALNUM)
            yield _without(b, text_col, w, _judge(w, index.value)[2], remove)

    return docs.mapInArrow(scan, docs.schema)


def _without(b: pa.RecordBatch, text_col: str, w: Words, mask: np.ndarray, remove: str) -> pa.RecordBatch:
    """The rows that stay, or all rows without the hit words of contaminated ones."""
    n = len(w.first) - 1
    owner = np.repeat(np.arange(n), np.diff(w.first))
    bad = _is_contaminated(np.bincount(owner[mask], minlength=n), np.diff(w.first))
    return b.filter(pa.array(~bad)) if remove == "documents" else _cut_spans(b, text_col, w, mask & bad[owner])


def _decontaminate_by_join(docs: DataFrame, found: DataFrame, remove: str, text_col: str) -> DataFrame:
    """Places of windows come back to their texts, where the words are counted; rows without any stay as they are."""
    names = docs.columns
    key, places = "_text_key", "_places"
    keyed = docs.withColumn(key, _text_key(text_col))
    met = _met(keyed.select(F.col(key).alias("key"), F.col(text_col).alias("text")), found)
    # At most one place for each word of a text: a row may hold them.
    held = met.groupBy("key").agg(F.collect_set(F.struct("at", "n")).alias(places)).withColumnRenamed("key", key)
    held = stage(held, "benchmark-places")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            w = words_of(*utf8(b.column(text_col)), ALNUM)
            at = [(w.first[d] + p["at"], p["n"]) for d, own in enumerate(b.column(places).to_pylist()) for p in own or []]
            lo, n = np.array(at, np.int64).reshape(-1, 2).T
            yield _without(b.select(names), text_col, w, covered(len(w.start), lo, lo + n), remove)

    return keyed.join(held, key, "left").select(*names, places).mapInArrow(scan, docs.schema)


def _cut_spans(b: pa.RecordBatch, text_col: str, w: Words, mask: np.ndarray) -> pa.RecordBatch:
    texts = b.column(text_col).to_pylist()
    offsets = utf8(b.column(text_col))[1]
    for d in np.unique(np.searchsorted(w.first, np.flatnonzero(mask), "right") - 1).tolist():
        own = mask[w.first[d] : w.first[d + 1]]
        edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
        lo = w.start[w.first[d] + np.flatnonzero(edge == 1)] - offsets[d]
        hi = w.end[w.first[d] + np.flatnonzero(edge == -1) - 1] - offsets[d]
        raw, kept = texts[d].encode(), []
        for s, e in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)]):
            kept.append(raw[s:e])
        texts[d] = b"".join(kept).decode()
    at = b.schema.get_field_index(text_col)
    return b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
