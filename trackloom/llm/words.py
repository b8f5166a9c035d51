"""Words and hashes of Arrow text columns, computed by numpy on the UTF-8 bytes.

All hashes are sums of mixed values times powers of an odd number modulo 2**64, so the hash of any
stretch is the difference of two prefix sums; no Python string is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SEGMENT = 1 << 18  # bytes hashed at a time; keeps the temporary arrays in the cache
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x += U((seed + 1) * _STEP & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=4)
def _powers(n: int, inverse: bool) -> np.ndarray:
    base = 0xD1342543DE82EF95
    if inverse:
        base = pow(base, -1, 1 << 64)
    out = np.full(n, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[s:e]`` for every pair of ``starts`` and ``ends`` (values already mixed)."""
    n = len(values)
    size = 1 << max(12, int(n + 1).bit_length())
    sums = np.zeros(n + 1, U)
    np.cumsum(values * _powers(size, False)[:n], out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(size, True)[starts]


@dataclass(frozen=True)
class Alphabet:
    """Which bytes make words (``code`` of others is 0) and how each byte counts in a hash."""

    is_word: np.ndarray
    code: np.ndarray


def alphabet(separators: list[int], fold_case: bool) -> Alphabet:
    is_word = np.ones(256, bool)
    is_word[separators] = False
    value = np.arange(256, dtype=U)
    if fold_case:
        value[65:91] += U(32)
    return Alphabet(is_word, mix(value, 77))


#: Letters and digits of ASCII and every other character; A-Z count as a-z.
ALNUM = alphabet([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], True)
#: Everything between blanks, unchanged.
BLANKS = alphabet([0x20, *range(0x09, 0x0E)], False)


@dataclass
class Words:
    """Words of consecutive documents: byte spans, hashes, and the first word of each document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # length: documents + 1

    def text(self, i: int, j: int, sep: bytes = b" ") -> bytes:
        d = self.data
        return sep.join(d[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (documents + 1) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes of text (a longer text is a piece of its own)."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows] if b.num_rows else []
        for i, j in zip(cuts, cuts[1:]):
            yield b.slice(i, j - i)
        give_back()


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that returns free memory to the system, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def give_back() -> None:
    """Return unused memory: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def words_of(data: np.ndarray, offsets: np.ndarray, kind: Alphabet) -> Words:
    starts, ends, hashes = [], [], []
    lo, n = 0, len(data)
    while lo < n:
        hi = _cut(data, offsets, kind, lo)
        piece = data[lo:hi]
        w = kind.is_word[piece]
        inner = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")] - lo
        before = np.empty(len(w), bool)
        before[0], before[1:] = False, w[:-1]
        before[inner] = False
        after = np.empty(len(w), bool)
        after[-1], after[:-1] = False, w[1:]
        after[inner - 1] = False
        s, e = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
        hashes.append(mix(span_hashes(kind.code[piece], s, e) + (e - s).astype(U)))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    join = lambda parts, kind_: np.concatenate(parts) if parts else np.zeros(0, kind_)
    start = join(starts, np.int64)
    return Words(data, start, join(ends, np.int64), join(hashes, U), np.searchsorted(start, offsets))


def _cut(data: np.ndarray, offsets: np.ndarray, kind: Alphabet, lo: int) -> int:
    """End of the segment that begins at ``lo``: a document's end, or a separator of a long one."""
    if lo + SEGMENT >= len(data):
        return len(data)
    at = int(offsets[np.searchsorted(offsets, lo + SEGMENT, "right") - 1])
    if at > lo:
        return at
    at = lo + SEGMENT
    while at < len(data):
        near = np.flatnonzero(~kind.is_word[data[at : at + 4096]])
        if len(near):
            return at + int(near[0])
        at += 4096
    return len(data)


def windows(w: Words, n: int, whole_short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word, and two hashes of every ``n`` consecutive words of one document.

    ``whole_short``: a document of fewer words, but not none, is one window.
    """
    count = np.diff(w.first)
    full = np.maximum(count - n + 1, (count > 0).astype(np.int64) if whole_short else 0)
    owner = np.repeat(np.arange(len(count)), full)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full) + w.first[owner]
    end = np.minimum(at + n, w.first[owner + 1])
    h = span_hashes(w.hash, at, end)
    size = (end - at).astype(U)
    return at, end, mix(h + size, 1), mix(span_hashes(mix(w.hash, 5), at, end) + size, 2)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in any of the half-open stretches."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def table(names: dict[str, pa.Array], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names[k], t) for k, t in types.items()], names=list(types))
