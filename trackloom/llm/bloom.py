"""A bit map of fixed size that tells which rows can't have a partner, to keep whole texts out of shuffles.

The map is built by the tasks in pieces and merged by piece in two steps (``merge_pieces``); it has ``BITS`` bits whatever the input, which
is the bound for sending it to the driver and to the tasks.  Rows that pass by chance are sorted out by the
join that follows; if the map fills up at some size of input, more rows pass and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import U, give_back, mix, table

BITS = 1 << 25
_PIECE = 1 << 16  # bytes
#: Tasks whose pieces one worker merges in the first step.
FAN = 256
PIECES = "key string, part int, task int, content binary"
PIECE_TYPES = {"key": pa.string(), "part": pa.int32(), "task": pa.int32(), "content": pa.binary()}


def _places(k64: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(k64.view(U), 31)
    return (h & U(BITS - 1)).astype(np.int64), (h >> U(38)).astype(np.int64) & (BITS - 1)


def merge_pieces(pieces: DataFrame, add: Callable[[np.ndarray, np.ndarray], np.ndarray], kind, fan: int = FAN) -> DataFrame:
    """One array per key from the (key, part, task, content) rows of all tasks, each of at most ``_PIECE`` bytes.

    First the pieces of ``fan`` tasks meet, then one row for each ``fan`` tasks: a worker takes at most
    ``fan`` pieces, then tasks / ``fan`` of them (4,000 pieces of 64 KB, 250 MB, at a million tasks).
    """

    def merge(t: pa.Table) -> pa.Array:
        total: np.ndarray | None = None
        for x in t.column("content"):
            own = np.frombuffer(x.as_buffer(), kind)
            total = own.copy() if total is None else add(total, own)
        return pa.array([total.tobytes()], pa.binary())

    def some(_: tuple, t: pa.Table) -> pa.Table:
        first = t.slice(0, 1)
        return pa.table({"key": first.column("key"), "part": first.column("part"), "task": first.column("task"), "content": merge(t)})

    def rest(_: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"key": t.column("key").slice(0, 1), "part": t.column("part").slice(0, 1), "content": merge(t)})

    grouped = pieces.withColumn("task", F.floor(F.col("task") / fan).cast("int"))
    met = grouped.groupBy("key", "part", "task").applyInArrow(some, PIECES)
    return met.groupBy("key", "part").applyInArrow(rest, "key string, part int, content binary")


def task_number() -> int:
    return TaskContext.get().partitionId()


def bit_map(keys: DataFrame, fan: int = FAN) -> np.ndarray:
    """Map of the one long column of ``keys`` (nulls are left out)."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS // 8, np.uint8)
        for b in batches:
            for p in _places(b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)):
                np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
        give_back()
        parts = bits.reshape(-1, _PIECE)
        used = np.flatnonzero(parts.any(axis=1))
        yield table({"key": [""] * len(used), "part": used, "task": [task_number()] * len(used), "content": [parts[i].tobytes() for i in used]}, PIECE_TYPES)

    merged = merge_pieces(keys.mapInArrow(fill, PIECES), np.bitwise_or, np.uint8, fan)
    out = np.zeros(BITS // 8, np.uint8)
    for r in merged.collect():  # BITS / 8 bytes at most
        out[r.part * _PIECE : (r.part + 1) * _PIECE] = np.frombuffer(r.content, np.uint8)
    return out


def may_hold(bits: np.ndarray, k64: np.ndarray) -> np.ndarray:
    out = np.ones(len(k64), bool)
    for p in _places(k64):
        out &= (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return out


def inside(column: pa.Array, bits: np.ndarray) -> np.ndarray:
    """Which rows may be in the map; a null is not."""
    ids = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return may_hold(bits, ids) & ~np.asarray(column.is_null())


def split(df: DataFrame, column: str, bits: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``column`` may be in the map, and the rest, which can't be; a null is in the rest."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def side(want: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(inside(b.column(column), shared.value) == want))
            give_back()

        return run

    return df.mapInArrow(side(True), df.schema), df.mapInArrow(side(False), df.schema)
