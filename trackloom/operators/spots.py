"""Reuse and colocalisation of spots: same frame, nearby place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.config import KEY
from trackloom.operators.neighbours import near_any

_ROW = [*KEY, "frame"]
_SPOT = ("spot_x", "spot_y")


def _fitted(points: DataFrame) -> DataFrame:
    return points.where("spot_x is not null and spot_y is not null")


def avoid_previous(points: DataFrame, r: float = 6.0) -> DataFrame:
    """Drop the fit of a point if a lower trajectory id has a spot strictly closer than r.

    One round: the earlier spot counts whether or not it was dropped itself.
    """
    spots = _fitted(points).select("movie", "trajectory", "frame", *_SPOT)
    taken = near_any(
        spots,
        spots,
        ["movie", "frame"],
        r,
        _ROW,
        inclusive=False,
        extra=F.col("o.trajectory") < F.col("p.trajectory"),
        xy=_SPOT,
    ).withColumn("_taken", F.lit(True))
    out = points.join(taken, _ROW, "left")
    for c in ("spot_x", "spot_y", "sigma", "peak", "intensity"):
        if c in points.columns:
            out = out.withColumn(c, F.when(F.col("_taken").isNull(), F.col(c)))
    return out.drop("_taken")


def forget_centres(past: DataFrame, centres: DataFrame, r: float = 6.0) -> DataFrame:
    """Past centres (movie, id, frame, x, y) that no given centre is strictly closer than r to."""
    ids = ["movie", "id"]
    gone = near_any(past, centres.select("movie", "frame", "x", "y"), ["movie", "frame"], r, ids, inclusive=False)
    return past.join(gone, ids, "left_anti")


def coloc_flags(points: DataFrame, spots: DataFrame, n_channels: int | DataFrame, r: float = 4.0) -> DataFrame:
    """Yes / No per point and other channel of its movie, NULL for unfitted points.

    ``spots`` holds movie, channel, frame, spot_x, spot_y of every channel;
    ``n_channels`` is one number or a table (movie, n_channels).
    """
    if isinstance(n_channels, DataFrame):
        points = points.drop("n_channels").join(n_channels.select("movie", "n_channels"), "movie")
        last = F.col("n_channels")
    else:
        last = F.lit(n_channels)
    others = F.sequence(F.lit(1), last)
    long = points.select(*_ROW, "channel", *_SPOT, F.explode(others).alias("target")).where("target <> channel")
    cand = spots.select("movie", "frame", F.col("channel").alias("target"), *_SPOT)
    hits = near_any(long, cand, ["movie", "frame", "target"], r, [*_ROW, "target"], xy=_SPOT)
    out = long.join(hits.withColumn("_hit", F.lit(True)), [*_ROW, "target"], "left")
    flag = F.when(F.col("spot_x").isNotNull() & F.col("spot_y").isNotNull(), F.when(F.col("_hit"), "Yes").otherwise("No"))
    return out.select(*_ROW, "channel", "target", flag.alias("flag"))


def coloc_any(flags: DataFrame) -> DataFrame:
    """Yes if any other channel has a spot there."""
    return flags.groupBy(*_ROW).agg(F.max("flag").alias("coloc"))


def coloc_percent(flags: DataFrame, n_channels: int, group: list[str] | None = None) -> DataFrame:
    """100 * Yes / known per target channel, one column per channel, own channel NULL."""
    group = group or KEY
    return (
        flags.groupBy(*group)
        .pivot("target", list(range(1, n_channels + 1)))
        .agg(F.round(100 * F.avg((F.col("flag") == "Yes").cast("double")), 1))
        .select(*group, *[F.col(str(c)).alias(f"ch{c}_pct") for c in range(1, n_channels + 1)])
    )
