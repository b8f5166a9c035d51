"""Line ROIs as arrays x and y: length, position along the line, projection, JSON.

A ROI is one record with its vertices inside, as it comes from the tables, so
these are plain row expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.folds import running


def segment_lengths(x: Column, y: Column) -> Column:
    """Length of each segment (empty for less than two vertices)."""

    def length(i: Column) -> Column:
        dx, dy = x[i + 1] - x[i], y[i + 1] - y[i]
        return F.sqrt(dx * dx + dy * dy)

    return F.when(F.size(x) < 2, F.array().cast("array<double>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 2, F.lit(0))), length)
    )


def roi_length(x: Column, y: Column) -> Column:
    return F.aggregate(segment_lengths(x, y), F.lit(0.0), lambda a, b: a + b)


def kymo_width(x: Column, y: Column) -> Column:
    """Number of samples along the line."""
    return F.greatest(F.floor(roi_length(x, y)), F.lit(2)).cast("int")


def segments(x: Column, y: Column) -> Column:
    """Array of (ax, ay, bx, by, len)."""
    lens = segment_lengths(x, y)
    return F.transform(
        lens,
        lambda n, i: F.struct(
            x[i].alias("ax"), y[i].alias("ay"), x[i + 1].alias("bx"), y[i + 1].alias("by"), n.alias("len")
        ),
    )


def lines(rois: DataFrame, *keep: str) -> DataFrame:
    """One row per ROI ready for many points: segments with the length before them, total, width.

    Columns movie, roi, ``keep``, x0, y0 (first vertex), segs, total, width.
    """
    first = F.col("x")[0].alias("x0"), F.col("y")[0].alias("y0")
    out = rois.select("movie", "roi", *keep, *first, segments(F.col("x"), F.col("y")).alias("_s"))
    out = out.withColumn("_c", running(F.col("_s"), F.lit(0.0), lambda cum, v: cum + v.len))
    total = F.element_at("_c", -1)
    return out.select(
        "movie",
        "roi",
        *keep,
        "x0",
        "y0",
        F.zip_with("_s", F.slice("_c", 1, F.size("_s")), lambda v, c: F.struct(v.ax, v.ay, v.bx, v.by, v.len, c.alias("cum"))).alias("segs"),
        total.alias("total"),
        F.greatest(F.floor(total), F.lit(2)).cast("int").alias("width"),
    )


def point_at(target: Column) -> Column:
    """Struct (x, y) at a distance along the line of a ``lines`` row, clamped to its ends."""
    last = F.get("segs", F.size("segs") - 1)
    hit = F.coalesce(F.get(F.filter("segs", lambda v: target < v.cum + v.len), F.lit(0)), last)
    t = F.when(hit.len > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (target - hit.cum) / hit.len))).otherwise(F.lit(0.0))
    return F.struct(
        F.coalesce(hit.ax + t * (hit.bx - hit.ax), F.col("x0")).alias("x"),
        F.coalesce(hit.ay + t * (hit.by - hit.ay), F.col("y0")).alias("y"),
    )


def roi_point(xk: Column) -> Column:
    """Struct (x, y) at kymograph column ``xk`` of a ``lines`` row."""
    return point_at(xk / F.col("width") * F.col("total"))


def roi_project(px: Column, py: Column) -> Column:
    """Kymograph column of the nearest place on a ``lines`` row; NULL for a line without length.

    The first segment wins a tie, segments without length are skipped.
    """

    def candidate(v: Column, i: Column) -> Column:
        vx, vy = v.bx - v.ax, v.by - v.ay
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - v.ax) * vx + (py - v.ay) * vy) / (v.len * v.len)))
        dx, dy = v.ax + t * vx - px, v.ay + t * vy - py
        return F.struct((dx * dx + dy * dy).alias("d"), i.alias("i"), (v.cum + t * v.len).alias("along"))

    best = F.array_min(F.transform(F.filter("segs", lambda v: v.len > 0), candidate))
    return F.when(px.isNotNull() & py.isNotNull() & (F.col("total") > 0), best["along"] / F.col("total") * F.col("width"))


def vertices(rois: DataFrame) -> DataFrame:
    """One row per vertex."""
    out = rois.select("movie", "roi", F.posexplode(F.arrays_zip("x", "y")).alias("i", "v"))
    return out.select("movie", "roi", "i", "v.x", "v.y")


def arc_length(rois: DataFrame) -> DataFrame:
    """Length of the line up to each vertex."""
    lens = segment_lengths(F.col("x"), F.col("y"))
    run = running(lens, F.lit(0.0), lambda cum, n: cum + n)
    return rois.select("movie", "roi", F.posexplode(run).alias("i", "arc"))


def roi_key(kind: Column, x: Column, y: Column) -> Column:
    """Canonical text of a ROI, equal for equal geometry."""
    points = F.arrays_zip(x.alias("x"), y.alias("y"))
    return F.to_json(F.struct(kind.alias("type"), x.alias("x"), y.alias("y"), points.alias("points")))


def roi_hash(kind: Column, x: Column, y: Column) -> Column:
    return F.xxhash64(roi_key(kind, x, y))
