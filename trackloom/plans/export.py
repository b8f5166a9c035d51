"""From points to the full set of result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.config import KEY, Params
from trackloom.operators.diffusion import cached_first, diffusion, diffusion_by_segment
from trackloom.operators.points import fixed_background, speeds, with_units
from trackloom.operators.segments import anchor_segments, in_segments, label_segments, one_per_frame
from trackloom.operators.spots import coloc_any, coloc_flags, coloc_percent
from trackloom.operators.steps import edge_smooth, label_steps, step_summary, steps
from trackloom.operators.summary import aggregate_row, per_kymograph, per_segment, per_trajectory
from trackloom.plans.stages import stage

SEGMENT = [*KEY, "segment"]
CALCULATIONS = ("steps", "diffusion", "colocalisation")


def backgrounds(points: DataFrame) -> DataFrame:
    """The fixed background per trajectory; NULL where the points don't tell."""
    if {"from_trajectory", "background"} <= set(points.columns):
        return fixed_background(points)
    return points.select(*KEY).distinct().withColumn("fixed_background", F.lit(None).cast("double"))


def _with_steps(points: DataFrame, known: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Summary per trajectory; points with step, level and level over the background."""
    found = stage(steps(stage(edge_smooth(points, p.step_window, p.step_passes), "smoothed"), p.min_step), "steps")
    labelled = label_steps(points.select(*KEY, "frame"), found).join(known, KEY, "left")
    over = F.col("level") - F.col("fixed_background")
    return step_summary(found, known), labelled.select(*KEY, "frame", "step", "level", over.alias("level_adjusted"))


def _segment_steps(rows: DataFrame, known: DataFrame, p: Params) -> DataFrame:
    smoothed = stage(edge_smooth(rows, p.step_window, p.step_passes, group=SEGMENT), "smoothed")
    return step_summary(steps(smoothed, p.min_step, SEGMENT), known, SEGMENT)


def _flags(points: DataFrame, movies: DataFrame, p: Params) -> tuple[DataFrame, int]:
    """Colocalisation flags of each movie's own channels, and the largest number of channels."""
    last = movies.agg(F.max("n_channels")).first()[0] or 0
    return stage(coloc_flags(points, points, movies, p.coloc_px), "coloc"), last


def _wide_flags(flags: DataFrame, last: int) -> DataFrame:
    wide = flags.groupBy(*KEY, "frame").pivot("target", list(range(1, last + 1))).agg(F.first("flag"))
    named = [F.col(str(c)).alias(f"coloc_ch{c}") for c in range(1, last + 1)]
    return wide.select(*KEY, "frame", *named).join(coloc_any(flags), [*KEY, "frame"])


def geometry(
    nodes: DataFrame, trajectory_rois: DataFrame, rois: DataFrame, anchors: DataFrame | None = None
) -> DataFrame:
    """Nested ``nodes``, ``anchors`` and ``roi_shape`` per trajectory: one cell each, as the tables want."""
    listed = one_per_frame(nodes).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("frame", "x", "y"))).alias("nodes"))
    kind = F.col("type") if "type" in rois.columns else F.lit("polyline")
    pairs = F.transform(F.arrays_zip("x", "y"), lambda v: F.array(v.x, v.y))
    shapes = rois.select("movie", "roi", F.struct(kind.alias("type"), "x", "y", pairs.alias("points")).alias("roi_shape"))
    out = trajectory_rois.select(*KEY, "roi").join(shapes, ["movie", "roi"], "left").join(listed, KEY, "full")
    if anchors is None:
        return out.withColumn("anchors", F.lit(None).cast("array<struct<frame:int,xk:double,yk:double>>"))
    down = F.col("yk") if "yk" in anchors.columns else F.col("frame").cast("double")
    cell = F.struct(F.col("frame").cast("int").alias("frame"), F.col("xk").cast("double").alias("xk"), down.alias("yk"))
    return out.join(anchors.groupBy(*KEY).agg(F.sort_array(F.collect_list(cell)).alias("anchors")), KEY, "left")


def result_tables(
    points: DataFrame,
    nodes: DataFrame,
    trajectory_rois: DataFrame,
    rois: DataFrame,
    movies: DataFrame,
    calculations: tuple[str, ...] = (),
    params: Params = Params(),
    anchors: DataFrame | None = None,
    fields: DataFrame | None = None,
    cached_diffusion: DataFrame | None = None,
) -> Mapping[str, DataFrame]:
    """All result tables of a set of movies.

    ``trajectory_rois`` maps (movie, trajectory) to its roi; ``fields`` has clicks and the map ``custom`` per
    trajectory; ``cached_diffusion`` has stored D and alpha per segment, which win over computed ones.  The
    per-trajectory table is stored, as three other tables are built on it.
    """
    known = stage(backgrounds(points), "backgrounds")
    shapes = geometry(nodes, trajectory_rois, rois, anchors)
    if fields is not None:
        shapes = shapes.join(fields, KEY, "left")
    per = per_trajectory(points, nodes, movies).join(known.withColumnRenamed("fixed_background", "background"), KEY, "left")
    rows = label_segments(with_units(speeds(points), movies), nodes)
    segs = stage(anchor_segments(nodes), "segments")
    inside = in_segments(points, segs)
    segments = per_segment(points, nodes, movies).join(known.withColumnRenamed("fixed_background", "background"), KEY, "left")
    if "steps" in calculations:
        summary, labelled = _with_steps(points, known, params)
        per, rows = per.join(summary, KEY, "left"), rows.join(labelled, [*KEY, "frame"], "left")
        segments = segments.join(_segment_steps(inside, known, params), SEGMENT, "left")
    if "diffusion" in calculations:
        per = per.join(diffusion(points, movies, params.max_lag, params.min_pairs).drop("lags"), KEY, "left")
        found = diffusion_by_segment(points, nodes, movies, params.max_lag, params.min_pairs)
        found = cached_first(cached_diffusion, found) if cached_diffusion is not None else found.drop("lags")
        segments = segments.join(found, SEGMENT, "left")
    if "colocalisation" in calculations:
        flags, last = _flags(points, movies, params)
        rows = rows.join(_wide_flags(flags, last), [*KEY, "frame"], "left")
        per = per.join(coloc_percent(flags, last), KEY, "left")
        segments = segments.join(coloc_percent(in_segments(flags, segs), last, SEGMENT), SEGMENT, "left")
    per = stage(per.join(shapes, KEY, "left"), "per-trajectory")
    ends = segs.select(*SEGMENT, *[F.col(f"{c}{i}").alias(f"node_{e}_{c}") for i, e in ((0, "start"), (1, "end")) for c in "xy"])
    cells = [c for c in ("anchors", "roi_shape", "clicks", "custom") if c in per.columns]
    return {
        "aggregate": aggregate_row(per, rois, movies),
        "points": rows,
        "per_trajectory": per,
        "per_segment": segments.join(ends, SEGMENT, "left").join(per.select(*KEY, *cells), KEY, "left"),
        "per_kymograph": per_kymograph(per, rois, movies),
        "per_kymograph_channel": per_kymograph(per, rois, movies, by_channel=True),
    }
