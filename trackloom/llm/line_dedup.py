"""Fuzzy line de-duplication: one line of each component of similar lines stays.

Lines end at ``\\n``.  Lines of fewer than ``min_chars`` characters are left alone: with 1, only empty ones.
A line's set are its windows of ``SHINGLE`` characters; a shorter line has none, so only exact copies of it go.  Lines of one content are one item; items whose
MinHash values agree in a whole band are compared exactly, set against set, and those of at least the
threshold are linked.  Components of links come from a distributed union-find; of each component the
occurrence with the smallest (id, line number) stays and the others go.

Defined results: rows without an id, or without text, come back as they are and take no part; rows that
repeat an id are one document, whose line numbers name the same places; a document may lose all its lines
(its text is then empty).  ``dedup_lines`` returns the input's columns with the text changed, in any order
of rows; its helper columns live apart from the row, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import bloom
from trackloom.llm.groups import (
    U,
    band_hashes,
    cells,
    components,
    in_cells,
    keys_of,
    min_hashes,
    pack,
    roots,
    shards_for,
    similar,
)
from trackloom.llm.words import give_back, mix, slices, span_hashes, table, utf8
from trackloom.plans.stages import stage

MIN_CHARS, SHINGLE, THRESHOLD = 20, 5, 0.8
#: 49 bands of 7 rows miss a pair at the threshold with probability 0.00001, and meet one of similarity 0.15,
#: as unrelated lines have, with 0.00008.
BANDS, ROWS = 49, 7
NEWLINE = 10
#: Bytes of text whose shingles are hashed at a time.
_PIECE = 1 << 18
#: Bytes of text whose band hashes are held at a time: some fifty times as many.
_PACKED = 1 << 20


#: Every byte counts as itself, in two ways.
_CODES = mix(np.arange(256, dtype=U), 78), mix(np.arange(256, dtype=U), 79)


class Lines:
    """Lines of consecutive documents: byte spans, document and number of each; only those that take part."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_chars: int):
        chars = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        breaks = np.flatnonzero(data == NEWLINE)
        start = np.union1d(breaks + 1, offsets[:-1])
        start = start[start < len(data)]
        end = np.append(start[1:], len(data))[: len(start)]
        end = end - (data[end - 1] == NEWLINE)
        owner = np.searchsorted(offsets, start, "right") - 1
        first = np.searchsorted(start, offsets[owner])
        long = chars[end] - chars[start] >= min_chars
        self.data, self.chars = data, chars
        self.number = (np.arange(len(start)) - first)[long]
        self.start, self.end, self.owner = start[long], end[long], owner[long]

    def hash(self, which: int) -> np.ndarray:
        """One of two hashes of each line's bytes."""
        h = np.zeros(len(self.start), U)
        for i, j, lo, hi in self._pieces():
            h[i:j] = span_hashes(_CODES[which][self.data[lo:hi]], self.start[i:j] - lo, self.end[i:j] - lo)
        return mix(h + (self.end - self.start).astype(U), 51)

    def _pieces(self) -> Iterator[tuple[int, int, int, int]]:
        """Ranges of lines and the bytes that they span."""
        i = 0
        while i < len(self.start):
            lo = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, lo + _PIECE, "right")))
            yield i, j, lo, int(self.end[j - 1])
            i = j

    def _codes(self, lo: int, hi: int) -> np.ndarray:
        return np.frombuffer(self.data[lo:hi].tobytes().decode().encode("utf-32-le"), np.uint32)

    def _stretch(self, i: int, j: int, lo: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First character of each line, the end of its shingles, and which lines are shorter than a shingle."""
        s, e = self.chars[self.start[i:j]] - self.chars[lo], self.chars[self.end[i:j]] - self.chars[lo]
        return s, np.maximum(e - size, s) + 1, e - s < size

    def signatures(self, chosen: np.ndarray, size: int, k: int) -> np.ndarray:
        """MinHash values of the chosen lines' shingles; each has one at least."""
        out = []
        for i, j, lo, hi in self._pieces():
            c = self._codes(lo, hi)
            h = np.zeros(len(c), np.uint32)
            for t in range(min(size, len(c))):
                h[: len(c) - t] += c[t:] * _FACTORS[t]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(12)
            h *= np.uint32(0x297A2D39)
            h ^= h >> np.uint32(15)
            s, e, _ = self._stretch(i, j, lo, size)
            own = chosen[i:j]
            out.append(min_hashes(h, s[own], e[own], k))
        return np.concatenate(out) if out else np.zeros((0, k), np.uint32)

    def has_set(self, size: int) -> np.ndarray:
        """Which lines are as long as a shingle."""
        return self.chars[self.end] - self.chars[self.start] >= size

    def sets(self, size: int) -> list[np.ndarray]:
        """Sorted distinct 64-bit hashes of each line's shingles."""
        out: list[np.ndarray] = []
        for i, j, lo, hi in self._pieces():
            c = self._codes(lo, hi).astype(U)
            h = np.zeros(len(c), U)
            for t in range(min(size, len(c))):
                h[: len(c) - t] += c[t:] * _FACTORS_64[t]
            s, e, short = self._stretch(i, j, lo, size)
            for n, (x, y) in enumerate(zip(s.tolist(), e.tolist())):
                if short[n]:
                    out.append(np.zeros(0, U))
                    continue
                v = np.sort(h[x:y])
                fresh = np.empty(len(v), bool)
                fresh[0] = True
                np.not_equal(v[1:], v[:-1], out=fresh[1:])
                out.append(v[fresh])
        return out


_FACTORS_64 = mix(np.arange(64, dtype=U), 83) | U(1)
_FACTORS = (mix(np.arange(64, dtype=U), 81) >> U(32)).astype(np.uint32) | np.uint32(1)


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, line, key) of every line that takes part."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = Lines(*utf8(b.column("text")), min_chars)
            yield table({"doc_id": b.column("doc_id").take(pa.array(x.owner)), "line": x.number, "key": keys_of(x.hash(0), x.hash(1))}, types)

    types = {"doc_id": pa.int64(), "line": pa.int64(), "key": pa.binary()}
    return docs.mapInArrow(scan, "doc_id long, line long, key binary")


def _packed(docs: DataFrame, min_chars: int, shingle: int, shards: int) -> DataFrame:
    """Band hashes of the lines, one for each content within a piece."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", _PACKED):
            x = Lines(*utf8(b.column("text")), min_chars)
            k64 = x.hash(0).view(np.int64)
            chosen = np.zeros(len(k64), bool)
            chosen[np.unique(k64, return_index=True)[1]] = True
            chosen &= x.has_set(shingle)
            bands = band_hashes(x.signatures(chosen, shingle, BANDS * ROWS), BANDS, ROWS)
            rows = list(pack(k64[chosen], bands, shards))
            yield table({"shard": [r[0] for r in rows], "hashes": [r[1] for r in rows], "items": [r[2] for r in rows]}, types)

    types = {"shard": pa.int32(), "hashes": pa.binary(), "items": pa.binary()}
    return docs.mapInArrow(scan, "shard int, hashes binary, items binary")


def _contents(docs: DataFrame, bits: np.ndarray, min_chars: int) -> DataFrame:
    """(key, k64, content) of the lines that may be in a cell, one for each content."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = Lines(*utf8(b.column("text")), min_chars)
            h1, h2 = x.hash(0), x.hash(1)
            k64 = h1.view(np.int64)
            wanted = np.flatnonzero(bloom.may_hold(shared.value, k64))
            wanted = wanted[np.unique(k64[wanted], return_index=True)[1]]
            content = [x.data[s:e].tobytes() for s, e in zip(x.start[wanted], x.end[wanted])]
            yield table({"key": keys_of(h1[wanted], h2[wanted]), "k64": k64[wanted], "content": content}, types)

    types = {"key": pa.binary(), "k64": pa.int64(), "content": pa.binary()}
    # Dealt out once, by what the cells are joined on; a piece has each content once at most.
    rows = docs.mapInArrow(scan, "key binary, k64 long, content binary").repartition("k64")
    return rows.groupBy("key", "k64").agg(F.first("content").alias("content"))


def _links(shingle: int, threshold: float):
    def run(b: pa.RecordBatch, bounds: list[int]) -> pa.RecordBatch:
        keys, side, content = b.column("key").to_pylist(), b.column("side").to_numpy(), b.column("content").to_pylist()
        offsets = np.append(0, np.cumsum([len(c) for c in content]))
        # A content holds no line break, so each is one line.
        sets = Lines(np.frombuffer(b"".join(content), np.uint8), offsets, 1).sets(shingle)
        first, second = [], []
        for i, j in zip(bounds, bounds[1:]):
            linked = similar(sets[i:j], threshold)
            if side[i:j].any():
                linked &= side[i:j, None] != side[None, i:j]
            root = roots(linked)
            for k in np.flatnonzero(root != np.arange(j - i)).tolist():
                first.append(keys[i + k])
                second.append(keys[i + int(root[k])])
        return table({"a": first, "b": second}, {"a": pa.binary(), "b": pa.binary()})

    return run


def repeated_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, lines): the numbers (from 0) of the lines that go, for each document that loses any."""
    if min_chars < 1:
        raise ValueError("min_chars: at least 1")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).dropna()
    places = stage(_occurrences(rows, min_chars), "line-places")
    texts = rows.select("text")
    found = stage(cells(_packed(texts, min_chars, shingle, shards_for(docs.count(), 2_000))), "line-cells")
    contents = _contents(texts, bloom.bit_map(found.select("k64").distinct()), min_chars)
    links = in_cells(found.join(contents, "k64"), _links(shingle, threshold), "a binary, b binary")
    # The links of an item come together first, so that contracting them leaves about one row for each item
    # and not one for each task that an item's cells reach.
    links = links.repartition(F.greatest("a", "b"))
    named = stage(components(links, "line-links"), "line-components")

    # Only places of lines that repeat, or that are linked, reach the joins.
    repeated = places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    involved = repeated.unionByName(named.select("key"))
    some, _ = bloom.split(places.withColumn("k64", _k64()), "k64", bloom.bit_map(involved.select(_k64())))
    some = some.join(named, "key", "left").select("doc_id", "line", F.coalesce("root", "key").alias("root"))
    some = stage(some, "line-repeated")
    stays = some.groupBy("root").agg(F.min(F.struct("doc_id", "line")).alias("stays"))
    met = some.join(stays, "root")
    goes = met.where((F.col("doc_id") != F.col("stays.doc_id")) | (F.col("line") != F.col("stays.line")))
    return goes.groupBy("doc_id").agg(F.array_distinct(F.collect_list("line")).alias("lines"))


def _k64(key: str = "key"):
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def _without(texts: list[str | None], lines: list[list[int] | None]) -> list[str | None]:
    """Each text without the lines of the given numbers; the others keep their breaks."""
    out = []
    for text, gone in zip(texts, lines):
        if text is not None and gone:
            parts, gone = text.split("\n"), set(gone)
            text = "\n".join(p for i, p in enumerate(parts) if i not in gone)
        out.append(text)
    return out


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    drop_empty: bool = False,
    count_col: str | None = None,
) -> DataFrame:
    """The input with repeated lines removed from its texts.

    ``drop_empty``: documents that lose their last line that isn't blank are left out.
    ``count_col``: name of a further column, the number of lines that went.
    """
    gone = stage(repeated_lines(docs, min_chars, shingle, threshold, id_col, text_col), "line-goes")
    changed, same = bloom.split(docs, id_col, bloom.bit_map(gone.select("doc_id")))
    row = changed.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # Never a broadcast: the tasks of ``split`` would run those of ``cut`` beside them, with twice the Python workers, which stay.
    met = row.join(gone.hint("merge"), row["row"][id_col].cast("long") == gone["doc_id"], "left").select("row", "lines")
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            fields = b.column("row").flatten()
            before, lines = fields[at].to_pylist(), b.column("lines").to_pylist()
            after = _without(before, lines)
            fields[at] = pa.array(after, fields[at].type)
            counts = [pa.array([len(x or ()) for x in lines], pa.int64())] if count_col else []
            out = pa.RecordBatch.from_arrays(fields + counts, names=result.names)
            if drop_empty:
                out = out.filter(pa.array([not x or t is None or bool(t.strip()) for t, x in zip(after, lines)], pa.bool_()))
            yield out
        give_back()

    if count_col:
        same = same.select("*", F.lit(0).cast("long").alias(count_col))
    result = same.schema
    return same.unionByName(met.mapInArrow(cut, result))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Per document: its lines (0 without text), how many of them went, and the text that is left."""
    lines = F.coalesce(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"))) + 1, F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), lines.alias("n_lines"))
    return dedup_lines(rows, **settings, count_col="n_removed").select("doc_id", "n_lines", "n_removed", "text")
