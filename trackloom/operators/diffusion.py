"""Mean squared displacement and the power-law fit MSD = 4 D t^alpha."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.config import KEY
from trackloom.operators.ordered import BLOCK, TILE, in_blocks, with_position
from trackloom.operators.segments import in_segment_rows


def msd(
    points: DataFrame,
    max_lag: int = 10,
    min_pairs: int = 5,
    eps: float = 1e-12,
    group: Sequence[str] = KEY,
    tile: int = TILE,
    block: int = BLOCK,
) -> DataFrame:
    """Per lag over the list of fitted points: mean squared displacement and mean frame gap."""
    group = list(group)
    fits = points.where("spot_x is not null and spot_y is not null").select(*group, "frame", "spot_x", "spot_y")
    rows = in_blocks(with_position(fits, group, "frame", tile=tile), after=max_lag, size=block)
    w = W.partitionBy(*group, "_block").orderBy("pos")
    ahead = F.array(
        *[
            F.struct(
                F.lit(k).alias("lag"),
                F.lead("spot_x", k).over(w).alias("x2"),
                F.lead("spot_y", k).over(w).alias("y2"),
                F.lead("frame", k).over(w).alias("f2"),
            )
            for k in range(1, max_lag + 1)
        ]
    )
    pairs = (
        rows.withColumn("_a", ahead)
        .where(~F.col("_ghost"))
        .select(*group, "frame", "spot_x", "spot_y", F.inline("_a"))
        .where("x2 is not null")
    )
    dx, dy = F.col("x2") - F.col("spot_x"), F.col("y2") - F.col("spot_y")
    return (
        pairs.groupBy(*group, "lag")
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.greatest(F.avg(dx * dx + dy * dy), F.lit(eps)).alias("msd"),
            F.avg(F.col("f2") - F.col("frame")).alias("dt"),
        )
        .where((F.col("pairs") >= min_pairs) & (F.col("pairs") + F.col("lag") >= 3))
    )


def fit_power_law(curve: DataFrame, movies: DataFrame, group: Sequence[str] = KEY) -> DataFrame:
    """Least squares of ln MSD on ln t; needs two lags and the scale of the movie."""
    x, y = F.log("dt"), F.log("msd")
    fit = curve.groupBy(*group).agg(
        F.count(F.lit(1)).alias("lags"),
        F.regr_slope(y, x).alias("alpha"),
        F.regr_intercept(y, x).alias("_b"),
    )
    ps = F.col("pixel_size_nm") / 1000
    dt = F.col("frame_interval_ms") / 1000
    return (
        fit.where("lags >= 2")
        .join(movies.select("movie", "pixel_size_nm", "frame_interval_ms"), "movie")
        .where("pixel_size_nm is not null and frame_interval_ms is not null")
        .select(*group, "lags", "alpha", (F.exp("_b") / 4 * ps * ps / F.pow(dt, F.col("alpha"))).alias("d_um2_s"))
    )


def diffusion(points: DataFrame, movies: DataFrame, max_lag: int = 10, min_pairs: int = 5, **kw) -> DataFrame:
    return fit_power_law(msd(points, max_lag, min_pairs, **kw), movies)


def diffusion_by_segment(
    points: DataFrame, nodes: DataFrame, movies: DataFrame, max_lag: int = 10, min_pairs: int = 5, tile: int = TILE
) -> DataFrame:
    group = [*KEY, "segment"]
    rows = in_segment_rows(points, nodes, tile)
    return fit_power_law(msd(rows, max_lag, min_pairs, group=group, tile=tile), movies, group)


def cached_first(cached: DataFrame, computed: DataFrame, group: Sequence[str] = (*KEY, "segment")) -> DataFrame:
    """Stored D and alpha where present, computed ones otherwise."""
    group = list(group)
    c = cached.select(*group, F.col("d_um2_s").alias("_d"), F.col("alpha").alias("_a"))
    out = computed.join(c, group, "full")
    return out.select(
        *group, F.coalesce("_d", "d_um2_s").alias("d_um2_s"), F.coalesce("_a", "alpha").alias("alpha")
    )
