"""Column expressions shared by the jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(intensity: Column) -> Column:
    """A point counts as valid if its spot was fitted and is brighter than zero."""
    return F.coalesce(intensity > 0, F.lit(False))


def to_number(text: Column) -> Column:
    """Number, or NULL for blank, bad or non-finite text."""
    n = F.trim(text.cast("string")).try_cast("double")
    bad = F.isnan(n) | (F.abs(n) == F.lit(float("inf")))
    return F.when(~bad, n)


def dist(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    return F.sqrt(dx * dx + dy * dy)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a segment; a segment without length is a point."""
    vx, vy = bx - ax, by - ay
    l2 = vx * vx + vy * vy
    t = F.when(l2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * vx + (py - ay) * vy) / l2)))
    t = F.coalesce(t, F.lit(0.0))
    return dist(px, py, ax + t * vx, ay + t * vy)


def um(px: Column, pixel_size_nm: Column) -> Column:
    return px * pixel_size_nm / 1000


def seconds(frames: Column, frame_interval_ms: Column) -> Column:
    return frames * frame_interval_ms / 1000


def um_per_s(px_per_frame: Column, pixel_size_nm: Column, frame_interval_ms: Column) -> Column:
    return px_per_frame * pixel_size_nm / frame_interval_ms


# Half-open class ranges, lower end included, and their labels.
ALPHA_RANGES = [
    (None, 0.5, "α < 0.5  (confined)"),
    (0.5, 0.9, "0.5–0.9  (subdiff.)"),
    (0.9, 1.1, "0.9–1.1  (Brownian)"),
    (1.1, 1.5, "1.1–1.5  (superdiff.)"),
    (1.5, None, "α ≥ 1.5  (directed)"),
]
D_RANGES = [
    (None, 0.01, "D < 0.01 μm²/s"),
    (0.01, 0.1, "0.01–0.1 μm²/s"),
    (0.1, 1.0, "0.1–1 μm²/s"),
    (1.0, None, "D ≥ 1 μm²/s"),
]


def range_class(value: Column, ranges: Sequence[tuple]) -> Column:
    """Label of the half-open range that holds the value; NULL becomes N/A."""
    out = F.when(value.isNull() | F.isnan(value), F.lit("N/A"))
    for _lo, hi, label in ranges:
        out = out.when(value < hi, F.lit(label)) if hi is not None else out.otherwise(F.lit(label))
    return out
