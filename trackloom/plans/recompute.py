"""Recompute points of trajectories from their anchors, nodes or coordinates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.config import KEY, Params
from trackloom.operators.points import speeds
from trackloom.operators.rois import densify_kymo
from trackloom.operators.segments import densify
from trackloom.plans.export import result_tables
from trackloom.plans.stages import stage
from trackloom.plans.tracking import track


def search_centres(anchors: DataFrame, rois: DataFrame, nodes: DataFrame, points: DataFrame) -> DataFrame:
    """Centres per frame: from anchors on their ROI, else from nodes, else the points' own."""
    cols = [*KEY, "frame", F.col("x").alias("search_x"), F.col("y").alias("search_y")]
    from_anchors = densify_kymo(anchors, rois).select(*cols)
    with_anchors = anchors.select(*KEY).distinct()
    rest = nodes.join(with_anchors, KEY, "left_anti")
    from_nodes = densify(rest).select(*cols)
    covered = with_anchors.unionByName(rest.groupBy(*KEY).agg(F.min("frame").alias("a"), F.max("frame").alias("z")).where("a < z").select(*KEY))
    own = points.join(covered, KEY, "left_anti").select(*KEY, "frame", "search_x", "search_y")
    return from_anchors.unionByName(from_nodes).unionByName(own)


def recompute(
    anchors: DataFrame,
    rois: DataFrame,
    nodes: DataFrame,
    points: DataFrame,
    trajectories: DataFrame,
    pixels: DataFrame,
    movies: DataFrame,
    mode: str = "independent",
    params: Params = Params(),
    only: DataFrame | None = None,
    avoid: bool = False,
    background: bool = True,
) -> DataFrame:
    """New points with speeds; ``only`` limits the work to some trajectories.

    By default the background of each trajectory is measured first and held fixed in every fit.

    ``trajectories`` gives the channel; its other columns (custom fields) are kept.
    """
    if only is not None:
        ids = only.select(*KEY).distinct()
        anchors, nodes, points, trajectories = (
            df.join(ids, KEY, "left_semi") for df in (anchors, nodes, points, trajectories)
        )
    windows = search_centres(anchors, rois, nodes, points).join(trajectories.select(*KEY, "channel"), KEY)
    measured = track(windows, pixels, movies, mode, params, avoid, background)
    if background:
        measured = measured.withColumn("from_trajectory", F.when(F.col("background").isNotNull(), "Yes"))
    extra = [c for c in trajectories.columns if c not in (*KEY, "channel")]
    out = speeds(measured)
    return out.join(trajectories.select(*KEY, *extra), KEY, "left") if extra else out


def recompute_results(
    anchors: DataFrame,
    rois: DataFrame,
    nodes: DataFrame,
    points: DataFrame,
    trajectories: DataFrame,
    trajectory_rois: DataFrame,
    pixels: DataFrame,
    movies: DataFrame,
    calculations: tuple[str, ...] = ("steps", "diffusion", "colocalisation"),
    **settings,
) -> Mapping[str, DataFrame]:
    """New points, stored once, and all result tables that follow from them."""
    fresh = stage(recompute(anchors, rois, nodes, points, trajectories, pixels, movies, **settings), "recomputed")
    fresh = fresh.drop("speed")
    params = settings.get("params", Params())
    return result_tables(fresh, nodes, trajectory_rois, rois, movies, calculations, params, anchors)
