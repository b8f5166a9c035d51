"""Running states of a fold over an array, in time linear in its length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements to a chunk: a list that grows is copied at each step, so steps append to short lists only.
CHUNK = 128


def running(values: Column, start: Column, step: Callable[[Column, Column], Column], size: int = CHUNK) -> Column:
    """``start`` and the state after each element: one more entry than ``values``; NULL for NULL.

    The elements are taken in order, one chunk after the other, so the states are those of a plain fold.
    """

    def states(values: Column) -> Column:
        pieces = F.ceil(F.size(values) / size).cast("int")
        starts = F.sequence(F.lit(0), F.greatest(pieces - 1, F.lit(0)))
        chunks = F.transform(starts, lambda i: F.slice(values, i * size + 1, F.lit(size)))
        done = F.aggregate(chunks, F.array(F.array(start)), through)
        # Each list but the first begins with the last state of the one before.
        return F.flatten(F.transform(done, lambda c, i: F.when(i == 0, c).otherwise(F.slice(c, 2, F.lit(size)))))

    def through(done: Column, chunk: Column) -> Column:
        begin = F.element_at(F.element_at(done, -1), -1)
        part = F.aggregate(chunk, F.array(begin), lambda acc, v: F.concat(acc, F.array(step(F.element_at(acc, -1), v))))
        return F.concat(done, F.array(part))

    # As the argument of a function the array is worked out once and not for each chunk.
    return F.when(values.isNotNull(), F.element_at(F.transform(F.array(values), states), 1))
