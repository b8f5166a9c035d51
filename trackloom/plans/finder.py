"""From accepted candidate tracks to measured trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.config import KEY, Params
from trackloom.operators.rois import densify_kymo
from trackloom.operators.tracks import tracks_to_anchors
from trackloom.plans.tracking import track


def found_anchors(nodes: DataFrame, rois: DataFrame, source: str = "finder") -> DataFrame:
    """Cleaned track nodes as anchors of new trajectories, with the movie of their line."""
    return tracks_to_anchors(nodes, source).join(rois.select("movie", "roi"), "roi")


def found_windows(nodes: DataFrame, rois: DataFrame, channel: int = 1) -> DataFrame:
    """One search window per frame between the nodes of a track, on the line of its kymograph."""
    centres = densify_kymo(found_anchors(nodes, rois), rois)
    return centres.select(*KEY, F.lit(channel).alias("channel"), "frame", F.col("x").alias("search_x"), F.col("y").alias("search_y"))


def found_trajectories(
    nodes: DataFrame,
    rois: DataFrame,
    pixels: DataFrame,
    movies: DataFrame,
    channel: int = 1,
    mode: str = "independent",
    params: Params = Params(),
    avoid: bool = False,
    background: bool = True,
    source: str = "finder",
) -> DataFrame:
    """Points of the trajectories that candidate tracks become: densified, then measured as any other."""
    windows = found_windows(nodes, rois, channel)
    return track(windows, pixels, movies, mode, params, avoid, background).withColumn("clicks", F.lit(source))
