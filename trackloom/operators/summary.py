"""Per-trajectory, per-segment, per-kymograph and per-movie tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.config import KEY
from trackloom.functions import scalars as S
from trackloom.functions.geometry import roi_length
from trackloom.operators.ordered import TILE
from trackloom.operators.points import speeds
from trackloom.operators.quantiles import exact_percentiles
from trackloom.operators.segments import anchor_segments, in_segments, one_per_frame
from trackloom.plans.stages import stage

_MEANS = {
    "mean_net_speed_um_s": "net_speed_um_s",
    "mean_speed_um_s": "speed_um_s",
    "mean_run_length_um": "distance_um",
    "mean_run_time_s": "time_s",
    "mean_median_intensity": "median_intensity",
    "mean_mean_intensity": "mean_intensity",
}


def _measures(
    rows: DataFrame, plain: DataFrame, group: list[str], movies: DataFrame
) -> DataFrame:
    """Shared measures of groups of ``rows``, which carry ``speed``; ``plain`` need not."""
    valid = F.when(S.is_valid(F.col("intensity")), F.col("intensity"))
    rows = rows.withColumn("_i", valid)
    placed = F.when(F.col("search_x").isNotNull() & F.col("search_y").isNotNull(), F.col("frame"))
    stats = rows.groupBy(*group).agg(
        F.min("channel").cast("int").alias("channel"),
        F.min("frame").alias("_f0"),
        F.max("frame").alias("_f1"),
        F.count(F.lit(1)).alias("total_points"),
        F.count("_i").alias("valid_points"),
        *[F.min_by(c, placed).alias(f"start_{c[-1]}") for c in ("search_x", "search_y")],
        *[F.max_by(c, placed).alias(f"end_{c[-1]}") for c in ("search_x", "search_y")],
        F.avg("_i").alias("mean_intensity"),
        F.avg("speed").alias("speed_px_frame"),
    )
    median = exact_percentiles(plain.withColumn("_i", valid), group, "_i", {"median_intensity": 0.5})
    out = stats.join(median, group, "left").join(
        movies.select("movie", "pixel_size_nm", "frame_interval_ms"), "movie", "left"
    )
    ps, fi = F.col("pixel_size_nm"), F.col("frame_interval_ms")
    gap = F.when(F.col("_f1") > F.col("_f0"), F.col("_f1") - F.col("_f0"))
    net = F.col("_px") / F.col("_gap")
    net_s = S.um_per_s(net, ps, fi)
    mean_s = S.um_per_s(F.col("speed_px_frame"), ps, fi)
    kept = [c for c in stats.columns if c not in ("_f0", "_f1")]
    return out.select(
        "*",
        S.dist(F.col("start_x"), F.col("start_y"), F.col("end_x"), F.col("end_y")).alias("_px"),
        gap.alias("_gap"),
    ).select(
        *kept,
        "median_intensity",
        (F.col("_f0") + 1).alias("start_frame"),
        (F.col("_f1") + 1).alias("end_frame"),
        (100.0 * F.col("valid_points") / F.col("total_points")).alias("percent_valid"),
        S.um(F.col("_px"), ps).alias("distance_um"),
        S.seconds(F.col("_gap"), fi).alias("time_s"),
        net.alias("net_speed_px_frame"),
        net_s.alias("net_speed_um_s"),
        (net_s * 60).alias("net_speed_um_min"),
        mean_s.alias("speed_um_s"),
        (mean_s * 60).alias("speed_um_min"),
    )


def per_trajectory(
    points: DataFrame, nodes: DataFrame, movies: DataFrame, tile: int = TILE
) -> DataFrame:
    """One row per trajectory: extent, validity, distance, time, speeds, intensities."""
    out = _measures(speeds(points, tile), points, KEY, movies)
    n = one_per_frame(nodes).groupBy(*KEY).agg(
        F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).cast("int").alias("segments"),
        *[F.min_by(c, "frame").alias(f"_a{c}") for c in "xy"],
        *[F.max_by(c, "frame").alias(f"_z{c}") for c in "xy"],
    )
    # A trajectory without any search centre shows its first and last node.
    ends = {f"{end}_{c}": F.coalesce(f"{end}_{c}", f"_{p}{c}") for end, p in (("start", "a"), ("end", "z")) for c in "xy"}
    out = out.join(n, KEY, "left").withColumns({"segments": F.coalesce("segments", F.lit(0)), **ends})
    return out.drop("_ax", "_ay", "_zx", "_zy")


def per_segment(
    points: DataFrame, nodes: DataFrame, movies: DataFrame, tile: int = TILE
) -> DataFrame:
    """The same measures between each pair of nodes; empty segments give no row."""
    # The segments are few next to the points and are read several times.
    segs = stage(anchor_segments(nodes, tile), "segments")
    rows = in_segments(speeds(points, tile), segs)
    plain = in_segments(points.select(*KEY, "frame", "intensity"), segs)
    return _measures(rows, plain, [*KEY, "segment"], movies)


def _rates(out: DataFrame, n: Column) -> DataFrame:
    per_min = n / F.when(F.col("total_time_s") > 0, F.col("total_time_s") / 60)
    per_um = per_min / F.when(F.col("total_distance_um") > 0, F.col("total_distance_um"))
    return out.withColumn("events_per_min", per_min).withColumn("events_per_um_per_min", per_um)


def per_kymograph(
    per_traj: DataFrame,
    rois: DataFrame,
    movies: DataFrame,
    include_empty: bool = True,
    by_channel: bool = False,
) -> DataFrame:
    """Counts, event rates and means per ROI (and channel).

    ``per_traj`` carries ``roi``.  Means are taken over unrounded values.
    """
    group = ["movie", "roi", *(["channel"] if by_channel else [])]
    stats = per_traj.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_trajectories"),
        *[F.avg(src).alias(name) for name, src in _MEANS.items()],
    )
    scale = movies.select("movie", "n_frames", "n_channels", "pixel_size_nm", "frame_interval_ms")
    spine = rois.select("movie", "roi", roi_length(F.col("x"), F.col("y")).alias("_len")).join(scale, "movie")
    if by_channel:
        spine = spine.withColumn("channel", F.explode(F.sequence(F.lit(1), "n_channels")))
    out = spine.join(stats, group, "left" if include_empty else "inner")
    out = (
        out.withColumn("n_trajectories", F.coalesce("n_trajectories", F.lit(0)))
        .withColumn("total_distance_um", S.um(F.col("_len"), F.col("pixel_size_nm")))
        .withColumn("total_time_s", S.seconds(F.col("n_frames"), F.col("frame_interval_ms")))
    )
    return _rates(out, F.col("n_trajectories")).select(
        *group,
        "total_distance_um",
        "total_time_s",
        "n_trajectories",
        "events_per_min",
        "events_per_um_per_min",
        *_MEANS,
    )


def aggregate_row(per_traj: DataFrame, rois: DataFrame, movies: DataFrame) -> DataFrame:
    """One row per movie over all its trajectories and ROIs."""
    stats = per_traj.groupBy("movie").agg(
        F.count(F.lit(1)).alias("n_trajectories"),
        *[F.avg(src).alias(name) for name, src in _MEANS.items()],
    )
    used = per_traj.select("movie", "roi").where("roi is not null").distinct().withColumn("_used", F.lit(1))
    lines = (
        rois.select("movie", "roi", roi_length(F.col("x"), F.col("y")).alias("_len"))
        .join(used, ["movie", "roi"], "left")
        .groupBy("movie")
        .agg(
            F.count(F.lit(1)).alias("total_kymographs"),
            F.sum("_len").alias("_len"),
            F.count_if(F.col("_used").isNull()).alias("empty_kymographs"),
        )
    )
    out = movies.join(stats, "movie", "left").join(lines, "movie", "left")
    ps = F.col("pixel_size_nm")
    out = (
        out.withColumn("n_trajectories", F.coalesce("n_trajectories", F.lit(0)))
        .withColumn("total_kymographs", F.coalesce("total_kymographs", F.lit(0)))
        .withColumn("empty_kymographs", F.coalesce("empty_kymographs", F.lit(0)))
        .withColumn("total_time_s", S.seconds(F.col("n_frames"), F.col("frame_interval_ms")))
        .withColumn("total_distance_um", S.um(F.coalesce("_len", F.lit(0.0)), ps))
        .withColumn("dimensions_px", F.concat_ws(", ", F.col("width").cast("string"), F.col("height").cast("string")))
        .withColumn(
            "dimensions_um",
            F.when(ps.isNotNull(), F.format_string("%.2f, %.2f", F.col("width") * ps / 1000, F.col("height") * ps / 1000)),
        )
    )
    return _rates(out, F.col("n_trajectories")).drop("_len", "height", "width", "n_channels")
