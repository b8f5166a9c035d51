"""Packing of tokenised documents into training sequences by best-fit decreasing.

A document's ids are those of the tokenizer plus a closing id.  It is first cut into full windows, each a
sequence of its own, and one remainder.  Remainders are dealt out by hash into groups of a bounded number of
documents; within a group they go, longest first, into the open window with the least sufficient room, which
a segment tree over remaining capacities finds.  Windows that stay open at the end are then closed from the
emptiest ones: their pieces are cut to fill the room of the fullest, and what is left of a group is one
window, whose content is cut into sequences of a power of two.  A sequence is padded to the window unless
its length is a power of two.

Defined results: null text is empty (its only id is the closing one); null and repeated ids are packed like
others, row by row; an empty table gives no rows.  Only id and text of the input are used.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import give_back, slices, table, utf8

WINDOW, CLOSING_ID = 2048, 1
#: Documents in one group of the packing, about.
GROUP_DOCS = 5_000
#: Bytes of text that are encoded at a time: what a worker holds meanwhile is some thirty times as much.
_SLICE = 2 << 20
#: Pieces of text whose ids a Python worker remembers (about 200 bytes each): those seen in several batches, and new ones.
REMEMBERED, NEW = 300_000, 200_000
#: Kinds of bytes: those of which nothing is known here, blanks, other white space, letters, digits, marks, the quote, other characters.
_ANY, _BLANK, _BREAK, _LETTER, _DIGIT, _MARK, _QUOTE, _OTHER = range(8)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[:128] = [
    _BLANK if c == " " else _BREAK if c in "\t\n\v\f\r" else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _QUOTE if c == "'" else _MARK if c.isprintable() else _ANY
    for c in map(chr, range(128))
]
#: First bytes of letters of two bytes: but for U+00D7 and U+00F7 all of U+00C0 to U+017F and U+0400 to U+047F.
_LETTER_FIRST = np.isin(np.arange(256), [0xC3, 0xC4, 0xC5, 0xD0, 0xD1])
#: First bytes of white space beyond ASCII.
_SPACE_FIRST = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_SPACES = [c.encode() for c in "\u0085\u00a0\u1680\u180e\u2028\u2029\u202f\u205f\u3000"] + [chr(c).encode() for c in range(0x2000, 0x2010)]


def _pairs(*pairs: tuple[tuple[int, ...], tuple[int, ...]]) -> np.ndarray:
    out = np.zeros(64, bool)
    for first, second in pairs:
        for x in first:
            out[[8 * x + y for y in second]] = True
    return out


_TEXT = (_LETTER, _DIGIT, _MARK, _QUOTE, _OTHER)
#: By the kinds of two bytes: whether a text may be cut between them, and whether it may be before the first.
_CUT_BETWEEN = _pairs(((_BREAK,), _TEXT), ((_LETTER,), (_DIGIT, _MARK, _QUOTE)), ((_DIGIT,), (_LETTER, _MARK, _QUOTE)), ((_MARK,), (_LETTER, _DIGIT)))
_CUT_BEFORE = _pairs(((_BLANK, _BREAK), _TEXT))


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut so that the ids of the pieces are those of the whole.

    The pattern of byte-level tokenizers takes runs of letters, of digits and of other characters, each with one
    blank before it, contractions that begin with a quote, and runs of white space, which leave their last
    character to the text that follows.  So there is a cut before the last white space of a run, after it unless
    it is a blank, and where letters, digits and marks meet; none after a quote or beside a character whose
    kind isn't known here.
    """
    kind = _KIND[data]
    if len(data) and data.max() > 127:
        at = np.flatnonzero(_LETTER_FIRST[data])
        at = at[(data[at] != 0xC3) | (data[at + 1] & 0xDF != 0x97)]
        kind[at] = kind[at + 1] = _LETTER
        at = np.flatnonzero(_SPACE_FIRST[data])
        for c in _SPACES:
            own = at[at + len(c) <= len(data)]
            for i, byte in enumerate(c):
                own = own[data[own + i] == byte]
            for i in range(len(c)):
                kind[own + i] = _ANY
    pair = kind[:-1] << 3 | kind[1:]
    starts = np.zeros(len(data) + 1, bool)
    before = _CUT_BEFORE[pair]
    ends = offsets[(offsets > 0) & (offsets < len(data))]
    before[ends - 1] = False  # white space at the end of a text is one run
    starts[: len(pair)] = before
    starts[1 : len(pair) + 1] |= _CUT_BETWEEN[pair]
    starts[offsets[:-1]] = True
    return np.flatnonzero(starts[: len(data)])


class Remembered:
    """Ids of pieces.  A piece that comes again in a later batch is kept longer than one seen once; the oldest go."""

    def __init__(self):
        self.often: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}

    def of(self, pieces: list[str]) -> tuple[list[bytes | None], list[int]]:
        """Ids of the distinct pieces, and the places of those that aren't known."""
        found: list[bytes | None] = list(map(self.often.get, pieces))
        missing = []
        for i in [i for i, x in enumerate(found) if x is None]:
            x = pieces[i]
            found[i] = ids = self.once.pop(x, None)
            if ids is None:
                missing.append(i)
            else:
                self.often[x] = ids
        return found, missing

    def forget(self) -> None:
        self.often, self.once = self._bounded(self.often, REMEMBERED), self._bounded(self.once, NEW)

    @staticmethod
    def _bounded(known: dict, most: int) -> dict:
        return known if len(known) <= most else dict(islice(known.items(), len(known) - most // 2, None))


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, piece by piece (``piece_starts``).

    A column's distinct pieces are looked up once and their ids remembered.  A text with the string of a special
    token, and every text of a tokenizer of another kind, is encoded as a whole.
    """

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        # A task has one core; threads of the tokenizer's own would each keep memory in the waiting worker.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Ids that begin with a blank, as byte-level vocabularies write it.
        self.blank_first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank_first[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remembered = Remembered()
        pattern = self.tokenizer.pre_tokenizer
        kind = json.loads(pattern.__getstate__()) if pattern else {}
        self.by_piece = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind["add_prefix_space"] and not self.tokenizer.normalizer

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _ids_after_blank(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of a blank and letters or digits: many at a time, cut where a blank begins."""
        out: list[bytes] = []
        for i in range(0, len(pieces), 2000):
            part = pieces[i : i + 2000]
            raw = self._ids(["".join(part)])[0]
            cut = np.flatnonzero(self.blank_first[np.frombuffer(raw, "<u4")])
            if len(cut) == len(part):
                at = (4 * cut).tolist()
                out += [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]
            else:
                out += self._ids(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.large_string()))

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """Ids of each text; null is empty."""
        whole = np.full(len(column), not self.by_piece)
        for x in self.special:
            whole |= pc.fill_null(pc.match_substring(column, x), False).to_numpy(zero_copy_only=False)
        rest = pc.if_else(pa.array(whole), pa.scalar("", column.type), column) if whole.any() else column
        out = self._by_piece(*utf8(rest))
        at = np.flatnonzero(whole)
        for i, ids in zip(at.tolist(), self._ids(pc.fill_null(column.take(pa.array(at)), "").to_pylist())):
            out[i] = ids
        return out

    def _by_piece(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        starts = piece_starts(data, offsets)
        first = np.searchsorted(starts, offsets)
        bounds = np.append(starts, len(data))
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        known = self._known(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin = np.cumsum(size) - size
        own = pieces.indices.to_numpy()
        size, begin = size[own], begin[own]
        ends = np.append(0, np.cumsum(size))
        ids = ids[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        at = (4 * ends[first]).tolist()
        return [ids[i:j] for i, j in zip(at, at[1:])]

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, in their order."""
        found, missing = self.remembered.of(pieces)
        single: list[int] = []
        rest: list[int] = []
        for i in missing:
            x = pieces[i]
            (single if x[0] == " " and x[1:].isalnum() else rest).append(i)
        for at, encode in ((single, self._ids_after_blank), (rest, self._ids)):
            new = [pieces[i] for i in at]
            for i, x, ids in zip(at, new, encode(new)):
                found[i] = self.remembered.once[x] = ids
        self.remembered.forget()
        return found


def cut(ids: bytes, window: int = WINDOW) -> list[tuple[int, int, int, bytes]]:
    """(start, length, crc32, ids) of a document's full windows and remainder."""
    n = len(ids) // 4
    out = []
    for i in range(0, n, window):
        piece = ids[4 * i : 4 * (i + window)]
        out.append((i, len(piece) // 4, crc32(piece), piece))
    return out


class Room:
    """Open windows by remaining capacity, with a segment tree that counts them."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._change(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The tightest window with room for ``length``: its capacity and number."""
        node = length + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._change(capacity, -1)
        return capacity, self.open[capacity].pop()

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Windows as lists of item numbers; items are taken longest first (ties: in order)."""
    room, windows = Room(window), []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = room.take(lengths[i])
        if found is None:
            found = window, len(windows)
            windows.append([])
        capacity, at = found
        windows[at].append(i)
        if capacity > lengths[i]:
            room.add(capacity - lengths[i], at)
    return windows


def fill(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, from, to): best fit, then the emptiest windows fill up the fullest."""
    full, partial = [], []
    for w in best_fit(lengths, window):
        total = sum(lengths[i] for i in w)
        (full if total == window else partial).append((total, [(i, 0, lengths[i]) for i in w]))
    partial.sort(key=lambda x: -x[0])
    lo, hi = 0, len(partial) - 1
    while lo < hi:
        total, items = partial[lo]
        left, source = partial[hi]
        item, a, b = source.pop()
        moved = min(window - total, b - a)
        items.append((item, b - moved, b))
        if b - moved > a:
            source.append((item, a, b - moved))
        partial[lo], partial[hi] = (total + moved, items), (left - moved, source)
        hi -= not source
        lo += total + moved == window
    out = [x[1] for x in full] + [x[1] for x in partial if x[0] == window]
    rest = [x for x in partial if 0 < x[0] < window]
    for total, items in rest:
        out += _powers(total, items)
    return out


def _powers(total: int, items: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The content of one window as sequences whose lengths are powers of two."""
    out, items = [], list(items)
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        need, part = 1 << bit, []
        while need:
            item, a, b = items.pop()
            used = min(need, b - a)
            part.append((item, a, a + used))
            if a + used < b:
                items.append((item, a + used, b))
            need -= used
        out.append(part)
    return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PIECE_TYPES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "ids": pa.binary()}


def _narrow(ids: bytes) -> bytes:
    """The ids in two bytes each, where all fit; their number tells which it is."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else ids


def _wide(ids: bytes, n: int) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if len(ids) == 2 * n else ids


def pieces(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", only_cut: bool = False
) -> DataFrame:
    """Full windows and remainders of every document with their ids.

    ``only_cut``: without the ids of full windows, and with two bytes for each of the others if they fit.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer)
        for b in slices(batches, "text", _SLICE):
            out: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode_column(b.column("text"))):
                ids += closing
                for start, length, crc, piece in cut(ids, window):
                    out.append((doc, start, length, crc, len(ids) // 4, piece if not only_cut else _narrow(piece) if length < window else None))
            yield table(dict(zip(_PIECE_TYPES, map(list, zip(*out)))), _PIECE_TYPES)

    return rows.mapInArrow(scan, _PIECES)


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece with its sequence and its place there; ``with_ids`` adds the ids themselves.

    A remainder that is cut again keeps its ids in the shuffle; all others travel as numbers only.
    """
    # Only remainders can be cut again, and their checksums need the ids.
    found = pieces(docs, tokenizer, window, id_col, text_col, only_cut=not with_ids)
    groups = 1 + docs.count() // GROUP_DOCS
    dealt = found.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("long"))

    def assign(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        group = key[0].as_py()
        length = t.column("length").to_numpy()
        doc, start, crc, tokens, ids = (t.column(c).to_pylist() for c in ("doc_id", "start", "ids_crc32", "doc_tokens", "ids"))
        n_full = int((length == window).sum())
        ids = [x if x is None else _wide(x, n) for x, n in zip(ids, length.tolist())]
        out = [(doc[i], start[i], window, crc[i], tokens[i], ids[i], group + groups * i, 0) for i in range(n_full)]
        for s, parts in enumerate(fill(length[n_full:].tolist(), window), n_full):
            offset = 0
            for i, a, b in parts:
                i += n_full
                piece = ids[i][4 * a : 4 * b]
                out.append((doc[i], start[i] + a, b - a, crc32(piece), tokens[i], piece if with_ids else None, group + groups * s, offset))
                offset += b - a
        del ids
        give_back()
        types = {**_PIECE_TYPES, "sequence_id": pa.int64(), "offset": pa.int64()}
        result = table(dict(zip(types, map(list, zip(*out)))), types)
        return pa.Table.from_batches([result])

    packed = dealt.groupBy("group").applyInArrow(assign, f"{_PIECES}, sequence_id long, offset long")
    return packed if with_ids else packed.drop("ids")


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_pad) of pieces packed ``with_ids``: whole sequences, padded as stated above.

    A sequence is at most one window of ids, so gathering its pieces is bounded.
    """

    def join(_: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("offset")
        ids = np.frombuffer(b"".join(t.column("ids").to_pylist()), "<u4").astype(np.int32)
        pad = 0 if len(ids) & (len(ids) - 1) == 0 else window - len(ids)
        ids = np.append(ids, np.full(pad, pad_id, np.int32))
        return pa.table({"sequence_id": t.column("sequence_id").slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int32())), "n_pad": pa.array([pad], pa.int64())})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids array<int>, n_pad long")
