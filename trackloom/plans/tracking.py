"""Tracking modes: from search centres and pixels to points."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.config import KEY, Params
from trackloom.functions.spot import measure
from trackloom.operators.measure import measure_spots, sigma_floor
from trackloom.operators.ordered import beside, in_blocks, with_position
from trackloom.operators.pixels import crop_pages, trajectory_background
from trackloom.operators.segments import densify
from trackloom.operators.smoothing import smooth_outliers
from trackloom.operators.spots import avoid_previous
from trackloom.plans.stages import stage

_FIT = ["spot_x", "spot_y", "sigma", "peak", "background", "intensity"]


def search_windows(nodes: DataFrame, trajectories: DataFrame, lag_compat: bool = False) -> DataFrame:
    """One search window per frame between the nodes; ``trajectories`` gives the channel."""
    centres = densify(nodes, lag_compat).withColumnsRenamed({"x": "search_x", "y": "search_y"})
    return centres.drop("segment").join(trajectories, KEY)


def with_background(
    windows: DataFrame, pixels: DataFrame, movies: DataFrame, params: Params = Params()
) -> DataFrame:
    """Windows with the background of their trajectory, which all modes then hold fixed in every fit."""
    found = trajectory_background(windows, pixels, movies, params.search_radius, params.background_border)
    found = found.withColumnRenamed("trajectory_background", "fixed_background")
    return windows.drop("fixed_background").join(found, KEY, "left")


def track_fixed(windows: DataFrame, pixels: DataFrame, movies: DataFrame, params: Params = Params()) -> DataFrame:
    """Measure exactly at the given centres."""
    return measure_spots(windows, pixels, movies, params)


def track_independent(
    windows: DataFrame,
    pixels: DataFrame,
    movies: DataFrame,
    params: Params = Params(),
    avoid: bool = False,
) -> DataFrame:
    """Measure each frame on its own; optionally drop spots used by an earlier trajectory."""
    points = measure_spots(windows, pixels, movies, params)
    return avoid_previous(stage(points, "measured"), params.same_spot_px) if avoid else points


def track_smooth(
    windows: DataFrame,
    pixels: DataFrame,
    movies: DataFrame,
    params: Params = Params(),
    avoid: bool = False,
) -> DataFrame:
    """Independent tracking, then a second measurement of rows that leave the smoothed path.

    A trajectory's fixed background holds in both measurements; ``avoid`` drops
    reused spots before the path is smoothed, as in independent tracking.
    """
    points = stage(track_independent(windows, pixels, movies, params, avoid), "measured")
    flags = smooth_outliers(points, params.smooth_px).where("outlier").select(
        *KEY,
        "channel",
        "frame",
        F.col("smooth_x").alias("search_x"),
        F.col("smooth_y").alias("search_y"),
        F.ceil(4 * F.col("mean_sigma")).cast("int").alias("crop"),
    )
    if "fixed_background" in windows.columns:
        flags = flags.join(windows.select(*KEY, "frame", "fixed_background"), [*KEY, "frame"])
    flags = stage(flags, "outliers")
    again = measure_spots(flags, pixels, movies, params).select(
        *KEY, "frame", F.lit(True).alias("_again"), *[F.col(c).alias(f"_{c}") for c in _FIT]
    )
    out = points.join(again, [*KEY, "frame"], "left")
    for c in _FIT:
        out = out.withColumn(c, F.when(F.col("_again"), F.col(f"_{c}")).otherwise(F.col(c)))
    return out.drop("_again", *[f"_{c}" for c in _FIT])


def track_sequential(
    windows: DataFrame,
    pixels: DataFrame,
    movies: DataFrame,
    params: Params = Params(),
    avoid: bool = False,
    page: int = 32,
) -> DataFrame:
    """Tracked mode: every frame starts at the blended centre of the frame before.

    A found spot leaves the centre within 2/e of a crop from the interpolated one,
    a miss leaves it half as far as it was, so how far it can be follows from the
    jumps of the last frames, and the pixels a frame can need are known beforehand
    (``with_reach``).  These travel in pages of ``page`` x ``page`` pixels.  Rows are
    dealt by trajectory and sorted by frame, and a task walks along them: it holds
    the pages of one frame that lie around the centre reached, however long the
    trajectory is.  A row without a search centre measures nothing, and the next one
    starts from its own.  ``avoid`` drops reused spots from the result; the path
    itself does not depend on other trajectories.
    """
    background = F.col("fixed_background") if "fixed_background" in windows.columns else F.lit(None).cast("double")
    sized = windows.select(*KEY, "channel", "frame", "search_x", "search_y", background.alias("fixed_background")).join(
        movies.select("movie", "height", "width", sigma_floor(F.col("pixel_size_nm")).alias("smin")), "movie"
    )
    rows = stage(with_position(sized, KEY, "frame"), "ordered")
    rows = stage(with_reach(rows, params), "reach")
    walked = _pages(rows, pixels, page).mapInArrow(_walk(params, page), _TRACKED)
    out = walked.withColumn("method", F.lit("moments"))
    return avoid_previous(stage(out, "tracked"), params.same_spot_px) if avoid else out


_TRACKED = (
    "movie string, channel int, frame int, trajectory long, search_x double, search_y double, "
    "track_x double, track_y double, " + ", ".join(f"{c} double" for c in _FIT)
)


def _pages(rows: DataFrame, pixels: DataFrame, page: int) -> DataFrame:
    """Each window row followed by its pixels, in the order of the walk.

    A window row has null ``row``; a page has its place (``row``, ``col``), and of each pixel the
    number inside the page and the value.
    """
    cx, cy, r = F.bround("search_x").cast("int"), F.bround("search_y").cast("int"), F.col("_r")
    packed = crop_pages(rows.select(*KEY, "channel", "frame", "pos", "search_x", "search_y", "_r"), pixels, page, cx - r, cx + r, cy - r, cy + r)
    packed = packed.select(*KEY, "pos", "row", "col", F.col("_p.at").alias("at"), F.col("_p.v").alias("v"))
    both = rows.drop("_r").unionByName(packed, allowMissingColumns=True)
    return both.repartition(*KEY).sortWithinPartitions(*KEY, "pos", F.col("row").asc_nulls_first(), "col")


def _walk(params: Params, page: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [f.split()[0] for f in _TRACKED.split(", ")]
    types = {"movie": pa.string(), "channel": pa.int32(), "frame": pa.int32(), "trajectory": pa.int64()}
    schema = pa.schema([(n, types.get(n, pa.float64())) for n in names])
    # Passes move the start of a crop by the tolerance each; at the image's edge a crop begins at the edge.
    reach = 2 * params.crop + params.fit_passes * params.edge_tol_px + 2

    def step(r: dict, cur: tuple[float, float], held: list[tuple[np.ndarray, ...]]) -> tuple[tuple[float, float], tuple]:
        """The centre after a frame, and the frame's result."""
        ix, iy = r["search_x"], r["search_y"]
        found = None
        if held:
            y, x, v = map(np.concatenate, zip(*held))
            found = measure(
                y,
                x,
                v,
                cur,
                params.crop,
                (r["height"], r["width"]),
                r["smin"],
                r["fixed_background"],
                snr=params.snr,
                tol=params.edge_tol_px,
                passes=params.fit_passes,
                border=params.fit_border,
                min_peak=params.min_peak,
            )
        if found is None:
            cur = ((cur[0] + ix) / 2, (cur[1] + iy) / 2)
        else:
            w = math.exp(-0.5 * math.hypot(found[0] - ix, found[1] - iy) / params.crop)
            cur = (w * found[0] + (1 - w) * ix, w * found[1] + (1 - w) * iy)
        fit = found if found is not None else (None,) * len(_FIT)
        return cur, (r["movie"], r["channel"], r["frame"], r["trajectory"], ix, iy, *cur, *fit)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: dict | None = None
        cur: tuple[float, float] | None = None
        held: list[tuple[np.ndarray, ...]] = []
        done: list[tuple] = []

        def settle() -> None:
            nonlocal row, cur
            if row is None:
                return
            if cur is None:
                done.append((*[row[n] for n in names[:6]], *[None] * (len(names) - 6)))
            else:
                cur, result = step(row, cur, held)
                done.append(result)
            held.clear()
            row = None

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done.clear()
            return out

        before = None
        for b in batches:
            is_page = np.asarray(b.column("row").is_valid())
            rows, cols = b.column("row").to_pylist(), b.column("col").to_pylist()
            plain = b.drop_columns(["row", "col", "at", "v"])
            at, v = b.column("at"), b.column("v")
            for i in range(b.num_rows):
                if is_page[i]:
                    if cur is None:
                        continue
                    y0, x0 = rows[i] * page, cols[i] * page
                    if x0 > cur[0] + reach or x0 + page < cur[0] - reach or y0 > cur[1] + reach or y0 + page < cur[1] - reach:
                        continue
                    place = at[i].values.to_numpy(zero_copy_only=False)
                    held.append((y0 + place // page, x0 + place % page, v[i].values.to_numpy(zero_copy_only=False)))
                    continue
                settle()
                row = plain.slice(i, 1).to_pylist()[0]
                own = (row["movie"], row["trajectory"])
                if row["search_x"] is None or row["search_y"] is None:
                    cur = None
                elif own != before or cur is None:
                    cur = (row["search_x"], row["search_y"])
                before = own
                if len(done) >= 4096:
                    yield flush()
        settle()
        if done:
            yield flush()

    return walk


#: Frames whose jumps are looked back on; a jump counts half as much with each frame.
_MEMORY = 64


def with_reach(rows: DataFrame, params: Params) -> DataFrame:
    """Positioned windows with ``_r``, how far from the centre the pixels of a frame can matter.

    With d the distance of the centre from the interpolated one after a frame, and jump the way to the
    next one: d' <= max(2/e crop, (d + jump) / 2), and the fit starts at most d + jump away.
    """
    near = params.crop * 2 / math.e
    rows = beside(rows, KEY, prev={"_bx": "search_x", "_by": "search_y"})
    jump = F.hypot(F.col("search_x") - F.col("_bx"), F.col("search_y") - F.col("_by"))
    rows = rows.withColumn("_jump", F.coalesce(jump, F.lit(0.0)))
    blocks = in_blocks(rows, "pos", before=_MEMORY)
    past = F.collect_list("_jump").over(W.partitionBy(*KEY, "_block").orderBy("pos").rowsBetween(-_MEMORY, -1))
    apart = F.aggregate(past, F.lit(near), lambda d, j: F.greatest(F.lit(near), (d + j) / 2))
    # What is older than the memory adds less than a pixel.
    reach = F.ceil(apart + F.col("_jump")).cast("int") + params.crop + int(params.edge_tol_px) + 3
    return blocks.withColumn("_r", reach).where("NOT _ghost").drop("_bx", "_by", "_jump", "_block", "_ghost")


def track(
    windows: DataFrame,
    pixels: DataFrame,
    movies: DataFrame,
    mode: str = "independent",
    params: Params = Params(),
    avoid: bool = False,
    background: bool = True,
) -> DataFrame:
    """Any mode, by default with the trajectory's background, which is measured once and stored."""
    if background:
        windows = stage(with_background(windows, pixels, movies, params), "windows")
    options = {} if mode == "same-centre" else {"avoid": avoid}
    return MODES[mode](windows, pixels, movies, params, **options)


MODES = {
    "independent": track_independent,
    "tracked": track_sequential,
    "smooth": track_smooth,
    "same-centre": track_fixed,
}
