"""Spot measurement in a window: gates, border background, two centred passes.

The estimator is background-subtracted moments, not a least-squares Gaussian;
the column ``method`` says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.config import Params
from trackloom.operators.pixels import WINDOW, crop_pixels, strip_count, strip_width

# Twice the width of a 200 nm spot, as full width over 2.355.
_MIN_WIDTH_NM = 2 * (200 / 2.355)


def sigma_floor(pixel_size_nm: Column) -> Column:
    return F.coalesce(_MIN_WIDTH_NM / pixel_size_nm, F.lit(1.0))


def measure_spots(
    windows: DataFrame,
    pixels: DataFrame,
    movies: DataFrame,
    params: Params = Params(),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Centre, sigma, peak, background and intensity per window; NULL where a gate fails.

    Windows: movie, channel, frame, trajectory, search_x, search_y and optionally
    crop (side, per row) and fixed_background.  One shuffle brings the pixels of
    a window together; all later steps work inside that window.
    """
    w = windows.select(
        *WINDOW,
        "search_x",
        "search_y",
        *keep,
        (F.col("crop") if "crop" in windows.columns else F.lit(params.crop)).cast("int").alias("_crop"),
        (F.col("fixed_background") if "fixed_background" in windows.columns else F.lit(None).cast("double")).alias("_bg"),
    ).join(movies.select("movie", "height", "width", "pixel_size_nm"), "movie")
    tol = params.edge_tol_px
    w = w.withColumns(
        {
            "_half": F.floor(F.col("_crop") / 2).cast("int"),
            "_rx": F.bround("search_x").cast("int"),
            "_ry": F.bround("search_y").cast("int"),
        }
    )
    half, rx, ry = F.col("_half"), F.col("_rx"), F.col("_ry")
    reach = half + int(tol) + 2
    rows = crop_pixels(
        w,
        pixels,
        rx - reach,
        F.greatest(rx + reach, F.col("_crop") + int(tol) + 2),
        ry - reach,
        F.greatest(ry + reach, F.col("_crop") + int(tol) + 2),
    )
    one = W.partitionBy(*WINDOW)
    x, y, v = F.col("x"), F.col("y"), F.col("v")

    gate = (x >= rx - half) & (x < rx + half) & (y >= ry - half) & (y < ry + half)
    g = F.when(gate, v)
    ok = F.max(g).over(one) - F.median(g).over(one) >= params.snr * F.stddev_pop(g).over(one)
    rows = rows.withColumn("_ok", ok).withColumn("_cx", F.col("search_x")).withColumn("_cy", F.col("search_y"))

    for _ in range(params.fit_passes):
        x0 = F.greatest(F.bround("_cx").cast("int") - half, F.lit(0))
        y0 = F.greatest(F.bround("_cy").cast("int") - half, F.lit(0))
        rows = rows.withColumns({"_x0": x0, "_y0": y0})
        x1, y1 = F.least(F.col("_x0") + F.col("_crop"), F.col("width")), F.least(F.col("_y0") + F.col("_crop"), F.col("height"))
        rows = rows.withColumns({"_x1": x1, "_y1": y1})
        inside = (x >= F.col("_x0")) & (x < F.col("_x1")) & (y >= F.col("_y0")) & (y < F.col("_y1"))
        box = F.col("_y0"), F.col("_y1"), F.col("_x0"), F.col("_x1")
        rows = rows.withColumn("_b", strip_width(*box, params.fit_border))
        strips = strip_count(*box, F.col("_b"))
        rows = rows.withColumns({"_v": F.when(inside, v), "_n": F.when(inside, strips).otherwise(0)})
        border = F.percentile(F.when(F.col("_n") > 0, F.col("_v")), F.lit(0.5), F.col("_n")).over(one)
        top, std = F.max("_v").over(one), F.stddev_pop("_v").over(one)
        rows = rows.withColumns({"_border": border, "_top": top, "_std": std})
        rows = rows.withColumn("_ok", F.col("_ok") & (F.col("_top") - F.col("_border") >= params.snr * F.col("_std")))
        rows = rows.withColumn("_off", F.coalesce("_bg", "_border"))
        rows = rows.withColumn("_q", F.greatest(F.col("_v") - F.col("_off"), F.lit(0.0)))
        q = F.col("_q")
        sums = {"_s": q, "_sx": q * x, "_sy": q * y, "_sxx": q * x * x, "_syy": q * y * y}
        rows = rows.withColumns({k: F.sum(e).over(one) for k, e in sums.items()})
        total = F.when(F.col("_s") > 0, F.col("_s"))
        mx, my = F.col("_sx") / total, F.col("_sy") / total
        rows = rows.withColumns(
            {
                "_sigx": F.sqrt(F.greatest(F.col("_sxx") / total - mx * mx, F.lit(0.0))),
                "_sigy": F.sqrt(F.greatest(F.col("_syy") / total - my * my, F.lit(0.0))),
                "_cx": F.greatest(F.col("_cx") - tol, F.least(F.col("_cx") + tol, mx)),
                "_cy": F.greatest(F.col("_cy") - tol, F.least(F.col("_cy") + tol, my)),
            }
        )
        fx, fy = F.col("_cx") - F.col("_x0"), F.col("_cy") - F.col("_y0")
        placed = (fx > tol) & (fx < F.col("_crop") - tol) & (fy > tol) & (fy < F.col("_crop") - tol)
        rows = rows.withColumn("_ok", F.col("_ok") & placed)

    lo, hi = sigma_floor(F.col("pixel_size_nm")), F.col("_crop") / 4.0

    def clamp(s: Column) -> Column:
        return F.greatest(lo, F.least(hi, s))

    sx, sy = clamp(F.col("_sigx")), clamp(F.col("_sigy"))
    peak = F.col("_top") - F.col("_off")
    rows = rows.withColumns(
        {
            "_peak": peak,
            "_sigma": 0.5 * (sx + sy),
            "_int": F.greatest(2 * F.pi() * peak * sx * sy, F.lit(0.0)),
            "_back": F.greatest(F.col("_off"), F.lit(0.0)),
        }
    )
    good = F.col("_ok") & (F.col("_peak") >= params.min_peak)
    found = rows.groupBy(*WINDOW).agg(
        *[
            F.max(F.when(good, F.col(src))).alias(name)
            for name, src in (
                ("spot_x", "_cx"),
                ("spot_y", "_cy"),
                ("sigma", "_sigma"),
                ("peak", "_peak"),
                ("background", "_back"),
                ("intensity", "_int"),
            )
        ]
    )
    base = windows.select(*WINDOW, "search_x", "search_y", *keep)
    return base.join(found, WINDOW, "left").withColumn("method", F.lit("moments"))
