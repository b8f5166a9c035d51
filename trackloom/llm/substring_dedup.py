"""Removal of long word passages that already occur in another document.

Words are stretches between blanks, unchanged.  A word goes if a window of ``window`` words that covers it
also starts in a document with a smaller id; windows are judged on the input.

First pass, a count-min sketch: equal windows have equal minimisers (the smallest hash of the half-window
word n-grams inside them), so the number of documents that hold a window is at most that of its minimiser.
A task counts its minimisers piece by piece; those met in two documents of a piece are known to repeat, the
others travel to the sketch's shard with their place.  The pieces' counts are added up in the shard's two
rows of cells, and the places come back whose count is 2 or more in both.  So the sketch overestimates and
loses no window; its number of shards follows the size of the input.

Second pass, exact: only windows at those places are hashed to 96 bits and grouped.  Within a piece, a
window that a smaller document of the same piece holds is settled at once; what is left goes to the shard
of its minimiser, which settles the rest.  So a passage of many documents reaches a shard once for each piece.

Defined results: null text has no words; rows without an id stay as they are; rows with equal ids are one
document to each other (neither removes the other's words), each judged by its own text.  The result
carries id, counts and the kept words joined by blanks, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import bloom
from trackloom.llm.words import BLANKS, U, Words, covered, mix, slices, table, utf8, windows, words_of
from trackloom.plans.stages import stage

WINDOW = 50
#: Cells in each of the two rows of a shard of the sketch, and minimisers that it gets, about.
CELLS, SHARE = 1 << 20, 1 << 17
#: Places or windows of a piece: what a task sorts at a time.
PIECE = 1 << 20
SHARDS_PER_GB = 48
_SPAN = np.dtype([("first", "<i4"), ("n", "<i4")])


def minimisers(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one minimiser: its hash, the document, the first window, how many."""
    size = window // 2
    width = window - size + 1
    at, _, m, _ = windows(w, size)
    done = 1
    while done < width:
        step = min(done, width - done)
        m = np.minimum(m[: len(m) - step], m[step:]) if len(m) > step else m[:0]
        done += step
    count = np.diff(w.first)
    n_windows = np.maximum(count - window + 1, 0)
    n_grams = np.maximum(count - size + 1, 0)
    doc = np.repeat(np.arange(len(count)), n_windows)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    m = m[np.repeat(np.cumsum(n_grams) - n_grams, n_windows) + place]
    new = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1]))) if len(m) else np.zeros(0, np.int64)
    return m[new], doc[new], place[new], np.diff(np.append(new, len(m)))


def _by_group(keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order that brings equal keys together, and the ranges of each in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    cuts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return order, list(zip(cuts.tolist(), np.append(cuts[1:], len(k)).tolist()))


def _spans_by_row(rid: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[list[int], list[bytes]]:
    order, ranges = _by_group(rid)
    spans = np.empty(len(rid), _SPAN)
    spans["first"], spans["n"] = first[order], n[order]
    r = rid[order]
    return [int(r[i]) for i, _ in ranges], [spans[i:j].tobytes() for i, j in ranges]


_PLACES = "shard int, rid long, spans binary, hashes binary, counts binary, rids binary, firsts binary, ns binary"
_PLACE_TYPES = {
    "shard": pa.int32(),
    "rid": pa.int64(),
    "spans": pa.binary(),
    **dict.fromkeys(["hashes", "counts", "rids", "firsts", "ns"], pa.binary()),
}


def _sketch_piece(m: np.ndarray, rid: np.ndarray, first: np.ndarray, n: np.ndarray, shards: int) -> pa.RecordBatch:
    """A piece's counts by shard, the places of minimisers met once, and the spans of those met more often."""
    order = np.lexsort((rid, m))
    m, rid, first, n = m[order], rid[order], first[order], n[order]
    new = np.append(True, m[1:] != m[:-1]) if len(m) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(m)) - 1
    several = rid[start] != rid[last] if len(m) else np.zeros(0, bool)
    rows: list[tuple] = []
    again = several[group] if len(m) else np.zeros(0, bool)
    for r, s in zip(*_spans_by_row(rid[again], first[again], n[again])):
        rows.append((r % shards, r, s, None, None, None, None, None))
    # A document may hold one minimiser at several places: all are kept, the first one counts.
    keep = ~again | new
    weight = np.where(again, 2, new).astype(np.uint8)[keep]
    m, rid, first, n = m[keep], rid[keep], first[keep], n[keep]
    shard = (mix(m, 61) % U(shards)).astype(np.int32)
    order, ranges = _by_group(shard)
    for i, j in ranges:
        o = order[i:j]
        rows.append((int(shard[o[0]]), None, None, m[o].tobytes(), weight[o].tobytes(), rid[o].tobytes(), first[o].astype("<i4").tobytes(), n[o].astype("<i4").tobytes()))
    return table(dict(zip(_PLACE_TYPES, map(list, zip(*rows)))) if rows else dict.fromkeys(_PLACE_TYPES, []), _PLACE_TYPES)


def _gather(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).drop_null().to_pylist()), kind)


def _estimated(_: tuple, t: pa.Table) -> pa.Table:
    """Adds up the pieces' counts in the cells of one shard and returns the places estimated to repeat."""
    m, weight = _gather(t, "hashes", U), _gather(t, "counts", np.uint8)
    repeated = np.ones(len(m), bool)
    for row in (62, 63):
        cell = (mix(m, row) % U(CELLS)).astype(np.int64)
        repeated &= np.bincount(cell, weights=weight, minlength=CELLS)[cell] >= 2
    repeated &= weight < 2  # places of the others are known already
    rid, first, n = _gather(t, "rids", np.int64), _gather(t, "firsts", "<i4"), _gather(t, "ns", "<i4")
    rids, spans = _spans_by_row(rid[repeated], first[repeated], n[repeated])
    known = t.select(["rid", "spans"]).filter(t.column("rid").is_valid())
    return pa.concat_tables([known.cast(_SPANS_SCHEMA), pa.table({"rid": rids, "spans": spans}, schema=_SPANS_SCHEMA)])


_SPANS_SCHEMA = pa.schema([("rid", pa.int64()), ("spans", pa.binary())])


def repeated_places(rows: DataFrame, window: int, shards: int, piece: int = PIECE) -> DataFrame:
    """(rid, spans): for each row with any, its windows that the sketch estimates to repeat."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in slices(batches, "text"):
            w = words_of(*utf8(b.column("text")), BLANKS)
            m, doc, first, n = minimisers(w, window)
            held.append((m, b.column("rid").to_numpy(zero_copy_only=False)[doc], first, n))
            if sum(len(h[0]) for h in held) >= piece:
                yield _sketch_piece(*map(np.concatenate, zip(*held)), shards)
                held = []
        if held:
            yield _sketch_piece(*map(np.concatenate, zip(*held)), shards)

    counted = rows.select("rid", "text").mapInArrow(scan, _PLACES)
    found = counted.groupBy("shard").applyInArrow(_estimated, "rid long, spans binary")
    return found.groupBy("rid").agg(F.collect_list("spans").alias("spans"))


_WINDOWS = "shard int, doc_id long, rid long, places binary, h1 binary, h2 binary, docs binary, rids binary, ats binary"
_WINDOW_TYPES = {
    "shard": pa.int32(),
    "doc_id": pa.int64(),
    "rid": pa.int64(),
    **dict.fromkeys(["places", "h1", "h2", "docs", "rids", "ats"], pa.binary()),
}


def _settle(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by window and document, and in it which windows a smaller document holds."""
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc = h1[order], h2[order], doc[order]
    new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) if len(h1) else np.zeros(0, bool)
    smallest = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h1) else doc
    return order, doc > smallest


def _places_by_row(doc: np.ndarray, rid: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.lexsort((rid, doc))
    doc, rid, at = doc[order], rid[order], at[order].astype("<i4")
    cuts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1]))) if len(doc) else np.zeros(0, np.int64)
    for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(doc)).tolist()):
        yield int(doc[i]), int(rid[i]), at[i:j].tobytes()


def _window_piece(m: np.ndarray, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, rid: np.ndarray, at: np.ndarray, shards: int) -> pa.RecordBatch:
    order, gone = _settle(h1, h2, doc)
    m, h1, h2, doc, rid, at = (x[order] for x in (m, h1, h2, doc, rid, at))
    rows: list[tuple] = [(r % shards, d, r, p, None, None, None, None, None) for d, r, p in _places_by_row(doc[gone], rid[gone], at[gone])]
    m, h1, h2, doc, rid, at = (x[~gone] for x in (m, h1, h2, doc, rid, at))
    # Equal windows have equal minimisers, and neighbours mostly share theirs: a row reaches few shards.
    shard = (mix(m, 64) % U(shards)).astype(np.int32)
    order, ranges = _by_group(shard)
    for i, j in ranges:
        o = order[i:j]
        # The rows of a piece are few: each window names its own by number.
        pairs, own = np.unique(np.stack([doc[o], rid[o]], axis=1), axis=0, return_inverse=True)
        numbered = np.stack([own.ravel(), at[o]], axis=1).astype("<u4")
        rows.append((int(shard[o[0]]), None, None, None, h1[o].tobytes(), h2[o].tobytes(), pairs[:, 0].astype(np.int64).tobytes(), pairs[:, 1].astype(np.int64).tobytes(), numbered.tobytes()))
    return table(dict(zip(_WINDOW_TYPES, map(list, zip(*rows)))) if rows else dict.fromkeys(_WINDOW_TYPES, []), _WINDOW_TYPES)


def _settled(_: tuple, t: pa.Table) -> pa.Table:
    """Rows settled before, and those of this shard's windows that a smaller document holds."""
    h1, h2 = _gather(t, "h1", U), _gather(t, "h2", np.uint32)
    doc, rid, at = [], [], []
    for docs, rids, ats in zip(*(t.column(c).to_pylist() for c in ("docs", "rids", "ats"))):
        if docs is not None:
            numbered = np.frombuffer(ats, "<u4").reshape(-1, 2)
            doc.append(np.frombuffer(docs, np.int64)[numbered[:, 0]])
            rid.append(np.frombuffer(rids, np.int64)[numbered[:, 0]])
            at.append(numbered[:, 1])
    out: list[tuple[int, int, bytes]] = []
    if doc:
        d, r, a = np.concatenate(doc), np.concatenate(rid), np.concatenate(at)
        order, gone = _settle(h1, h2, d)
        out = list(_places_by_row(d[order][gone], r[order][gone], a[order][gone]))
    known = t.select(["doc_id", "rid", "places"]).filter(t.column("rid").is_valid()).cast(_SETTLED_SCHEMA)
    return pa.concat_tables([known, pa.table(dict(zip(_SETTLED_SCHEMA.names, map(list, zip(*out)))) if out else {k: [] for k in _SETTLED_SCHEMA.names}, schema=_SETTLED_SCHEMA)])


_SETTLED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("places", pa.binary())])


def repeated_windows(rows: DataFrame, estimated: DataFrame, window: int, shards: int, piece: int = PIECE) -> DataFrame:
    """(doc_id, rid, places): first words of the windows that a document with a smaller id holds too."""
    may_repeat, _ = bloom.split(rows, "rid", bloom.bit_map(estimated.select("rid")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in slices(batches, "text"):
            w = words_of(*utf8(b.column("text")), BLANKS)
            at, _, h1, h2 = windows(w, window)
            chosen = _chosen(w, b.column("spans").to_pylist(), window)
            doc = np.searchsorted(w.first, at[chosen], "right") - 1
            ids, rids = (b.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("doc_id", "rid"))
            m, _, _, n = minimisers(w, window)
            held.append((np.repeat(m, n)[chosen], h1[chosen], (h2[chosen] >> U(32)).astype(np.uint32), ids, rids, at[chosen] - w.first[doc]))
            if sum(len(h[0]) for h in held) >= piece:
                yield _window_piece(*map(np.concatenate, zip(*held)), shards)
                held = []
        if held:
            yield _window_piece(*map(np.concatenate, zip(*held)), shards)

    found = may_repeat.join(estimated, "rid").select("doc_id", "rid", "text", "spans").mapInArrow(scan, _WINDOWS)
    settled = found.groupBy("shard").applyInArrow(_settled, "doc_id long, rid long, places binary")
    return settled.groupBy("doc_id", "rid").agg(F.collect_list("places").alias("places"))


def _chosen(w: Words, spans: list[list[bytes]], window: int) -> np.ndarray:
    """Which of all windows, in order, lie in the documents' spans."""
    n_windows = np.maximum(np.diff(w.first) - window + 1, 0)
    base = np.cumsum(n_windows) - n_windows
    lo, hi = [], []
    for d, own in enumerate(spans):
        x = np.frombuffer(b"".join(own), _SPAN)
        # Spans of another row whose hash is the same by chance may reach too far.
        lo.append(np.minimum(x["first"], n_windows[d]) + base[d])
        hi.append(np.minimum(x["first"] + x["n"], n_windows[d]) + base[d])
    total = int(n_windows.sum())
    return covered(total, np.concatenate(lo), np.concatenate(hi)) if lo else np.zeros(total, bool)


def _cut(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 8 << 20):
            n_words, n_removed, texts = [], [], []
            for text, places in zip(b.column("text").to_pylist(), b.column("places").to_pylist()):
                words = (text or "").encode().split()  # at the same blanks as words.BLANKS
                n_words.append(len(words))
                gone = 0
                if places:
                    at = np.frombuffer(b"".join(places), "<i4").astype(np.int64)
                    mask = covered(len(words), at, at + window)
                    gone = int(mask.sum())
                    words = compress(words, (~mask).tolist())
                n_removed.append(gone)
                texts.append(b" ".join(words).decode())
            yield table({"doc_id": b.column("doc_id"), "n_words": n_words, "n_removed": n_removed, "text": texts}, types)

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """One row per document: its words, how many of them go, and the kept words joined by blanks."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A minimiser for every 90 bytes of text, about.
    places = repeated_places(rows.dropna(), window, 16 + size // (90 * SHARE), piece)
    places = stage(places, "substring-places")
    gone = stage(repeated_windows(rows.dropna(), places, window, 16 + size * SHARDS_PER_GB // 10**9, piece), "substring-windows")
    may_change, same = bloom.split(rows, "rid", bloom.bit_map(gone.select("rid")))
    out = "doc_id long, n_words long, n_removed long, text string"
    changed = may_change.join(gone, ["doc_id", "rid"], "left").select("doc_id", "text", "places").mapInArrow(_cut(window), out)
    same = same.select("doc_id", "text", F.lit(None).cast("array<binary>").alias("places"))
    return changed.unionByName(same.mapInArrow(_cut(window), out))
