"""Gap filling, local quadratic smoothing and outliers of a spot path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.config import KEY
from trackloom.functions import scalars as S
from trackloom.operators.ordered import BLOCK, TILE, in_blocks, nearest, with_position


def interpolate_gaps(points: DataFrame, x: str = "spot_x", y: str = "spot_y", tile: int = TILE) -> DataFrame:
    """Fill missing places linearly over the row index, flat at both ends.

    Adds ``pos``, ``fill_x`` and ``fill_y``.
    """
    rows = with_position(points, KEY, "frame", tile=tile)
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = nearest(
        rows,
        KEY,
        "frame",
        prev={"_pp": "pos", "_px": x, "_py": y},
        next={"_np": "pos", "_nx": x, "_ny": y},
        where=known,
        tile=tile,
    )
    t = (F.col("pos") - F.col("_pp")) / (F.col("_np") - F.col("_pp"))
    for c, p, n in ((x, "_px", "_nx"), (y, "_py", "_ny")):
        mid = F.col(p) + t * (F.col(n) - F.col(p))
        out = out.withColumn(f"fill_{c[-1]}", F.when(known, F.col(c)).otherwise(F.coalesce(mid, F.col(p), F.col(n))))
    return out.drop("_pp", "_px", "_py", "_np", "_nx", "_ny")


def savgol(rows: DataFrame, window: int = 11, block: int = BLOCK) -> DataFrame:
    """Local quadratic fit of fill_x and fill_y, the end windows evaluated off-centre.

    Needs ``pos``.  Shorter traces use the largest odd window that fits; traces
    of fewer than three rows give NULL.
    """
    reach = window - 1
    b = in_blocks(rows, before=reach, after=reach, size=block)
    w = W.partitionBy(*KEY, "_block").orderBy("pos").rowsBetween(-reach, reach)
    b = b.withColumn("_w", F.collect_list(F.struct("pos", "fill_x", "fill_y")).over(w)).where(~F.col("_ghost"))
    # Seen from any row, a visible last row is the true last row of the trace.
    n = F.element_at("_w", -1)["pos"] + 1
    m = F.least(F.lit((window - 1) // 2), F.floor((n - 1) / 2))
    b = b.withColumn("_m", m).withColumn("_c", F.greatest(m, F.least(F.col("pos"), n - 1 - m)))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("x0", "x1", "x2", "y0", "y1", "y2")])

    def add(a: Column, v: Column) -> Column:
        j = (v.pos - F.col("_c")).cast("double")
        return F.struct(
            (a.x0 + v.fill_x).alias("x0"),
            (a.x1 + j * v.fill_x).alias("x1"),
            (a.x2 + j * j * v.fill_x).alias("x2"),
            (a.y0 + v.fill_y).alias("y0"),
            (a.y1 + j * v.fill_y).alias("y1"),
            (a.y2 + j * j * v.fill_y).alias("y2"),
        )

    near = F.filter("_w", lambda v: F.abs(v.pos - F.col("_c")) <= F.col("_m"))
    b = b.withColumn("_s", F.aggregate(near, zero, add))
    mm = F.col("_m").cast("double")
    s0 = 2 * mm + 1
    s2 = mm * (mm + 1) * s0 / 3
    s4 = s2 * (3 * mm * mm + 3 * mm - 1) / 5
    det = s0 * s4 - s2 * s2
    d = (F.col("pos") - F.col("_c")).cast("double")
    for c in "xy":
        t0, t1, t2 = (F.col(f"_s.{c}{i}") for i in range(3))
        fit = (s4 * t0 - s2 * t2) / det + t1 / s2 * d + (s0 * t2 - s2 * t0) / det * d * d
        b = b.withColumn(f"smooth_{c}", F.when(mm >= 1, fit))
    return b.select(*rows.columns, "smooth_x", "smooth_y")


def smooth_outliers(points: DataFrame, px: float = 3.0, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """Flag rows further from the smoothed path than min(px, 2 * mean sigma).

    Trajectories with fewer than two fits have no outliers.
    """
    rows = savgol(interpolate_gaps(points, tile=tile), block=block)
    stats = points.groupBy(*KEY).agg(F.avg("sigma").alias("mean_sigma"), F.count("spot_x").alias("_fits"))
    out = rows.join(stats, KEY)
    off = S.dist(F.col("fill_x"), F.col("fill_y"), F.col("smooth_x"), F.col("smooth_y"))
    flag = (F.col("_fits") >= 2) & (off > F.least(F.lit(px), 2 * F.col("mean_sigma")))
    return out.withColumn("deviation", off).withColumn("outlier", F.coalesce(flag, F.lit(False))).drop("_fits")
