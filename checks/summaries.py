"""Summary tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.points import LABELLED, SEGMENTS, SPEED, K
from checks.registry import register
from checks.views import sql_with
from trackloom.config import KEY
from trackloom.operators import summary as M

MEASURES = """
  min(channel) AS channel, min(frame) + 1 AS start_frame, max(frame) + 1 AS end_frame, count(*) AS total_points,
  count(*) FILTER (WHERE intensity > 0) AS valid_points,
  100.0 * count(*) FILTER (WHERE intensity > 0) / count(*) AS percent_valid,
  arg_min(search_x, frame) AS start_x, arg_min(search_y, frame) AS start_y,
  arg_max(search_x, frame) AS end_x, arg_max(search_y, frame) AS end_y,
  avg(intensity) FILTER (WHERE intensity > 0) AS mean_intensity,
  median(intensity) FILTER (WHERE intensity > 0) AS median_intensity,
  avg(speed) AS speed_px_frame, nullif(max(frame) - min(frame), 0) AS gap"""

DERIVED = """
  sqrt((end_x - start_x) * (end_x - start_x) + (end_y - start_y) * (end_y - start_y)) AS px"""

WITH_UNITS = """
  px * pixel_size_nm / 1000 AS distance_um, gap * frame_interval_ms / 1000 AS time_s, px / gap AS net_speed_px_frame,
  px / gap * pixel_size_nm / frame_interval_ms AS net_speed_um_s,
  px / gap * pixel_size_nm / frame_interval_ms * 60 AS net_speed_um_min,
  speed_px_frame * pixel_size_nm / frame_interval_ms AS speed_um_s,
  speed_px_frame * pixel_size_nm / frame_interval_ms * 60 AS speed_um_min"""

COLS = (
    "channel:i start_frame:i end_frame:i total_points:l valid_points:l percent_valid:d start_x:d start_y:d end_x:d "
    "end_y:d distance_um:d time_s:d mean_intensity:d median_intensity:d net_speed_px_frame:d net_speed_um_s:d "
    "net_speed_um_min:d speed_px_frame:d speed_um_s:d speed_um_min:d"
)

PER_TRAJ = f"""
SELECT t.*, {WITH_UNITS}, greatest(coalesce(n.n, 0) - 1, 0) AS segments
FROM (SELECT *, {DERIVED} FROM (SELECT movie, trajectory, {MEASURES} FROM ({SPEED}) v GROUP BY movie, trajectory) g) t
JOIN fx_movies USING (movie)
LEFT JOIN (SELECT trajectory, count(*) AS n FROM fx_nodes GROUP BY ALL) n USING (trajectory)"""


def per_traj(s, d):
    return M.per_trajectory(V.points(s, d), V.nodes(s, d), V.movies(s, d))


def with_roi(s, d):
    """A trajectory lies on the ROI with its own number."""
    return per_traj(s, d).withColumn("roi", F.col("trajectory"))


register("d1_per_trajectory", f"{K} segments:i {COLS}", per_traj, sql_with("fx_nodes fx_movies", PER_TRAJ))

register(
    "d2_per_segment",
    f"{K} segment:i {COLS}",
    lambda s, d: M.per_segment(V.points(s, d), V.nodes(s, d), V.movies(s, d)),
    sql_with(
        "fx_nodes fx_movies",
        f"""SELECT t.*, {WITH_UNITS}
            FROM (SELECT *, {DERIVED} FROM (
                    SELECT v.movie, v.trajectory, segment, {MEASURES} FROM ({SPEED}) v JOIN ({SEGMENTS}) s
                      ON s.trajectory = v.trajectory AND v.frame BETWEEN s.start_frame AND s.end_frame
                    GROUP BY v.movie, v.trajectory, segment) g) t
            JOIN fx_movies USING (movie)""",
    ),
)

MEANS = """
  avg(net_speed_um_s) AS mean_net_speed_um_s, avg(speed_um_s) AS mean_speed_um_s, avg(distance_um) AS mean_run_length_um,
  avg(time_s) AS mean_run_time_s, avg(median_intensity) AS mean_median_intensity, avg(mean_intensity) AS mean_mean_intensity"""
MEAN_COLS = " ".join(f"{m}:d" for m in M._MEANS)
RATES = """
  n_frames * frame_interval_ms / 1000 AS total_time_s,
  n_trajectories / (n_frames * frame_interval_ms / 1000 / 60) AS events_per_min,
  n_trajectories / (n_frames * frame_interval_ms / 1000 / 60) / nullif(total_distance_um, 0) AS events_per_um_per_min"""
LENGTHS = "SELECT movie, roi, sum(len) AS len FROM fx_segments GROUP BY ALL"

for _name, _ch in (("d3_per_kymograph", False), ("d4_per_kymograph_channel", True)):
    _g = ", channel" if _ch else ""
    _spine = f"(SELECT *, unnest([1, 2]) AS channel FROM ({LENGTHS}) q)" if _ch else f"({LENGTHS})"
    register(
        _name,
        f"movie:s roi:l {'channel:i ' if _ch else ''}total_distance_um:d total_time_s:d n_trajectories:l events_per_min:d "
        f"events_per_um_per_min:d {MEAN_COLS}",
        lambda s, d, c=_ch: M.per_kymograph(with_roi(s, d), V.rois(s, d), V.movies(s, d), by_channel=c),
        sql_with(
            "fx_nodes fx_movies fx_segments",
            f"""SELECT *, {RATES} FROM (
                  SELECT l.*, m.n_frames, m.frame_interval_ms, len * pixel_size_nm / 1000 AS total_distance_um,
                    coalesce(n, 0) AS n_trajectories, t.* EXCLUDE (movie, roi, n{_g})
                  FROM {_spine} l JOIN fx_movies m USING (movie)
                  LEFT JOIN (SELECT movie, trajectory AS roi{_g}, count(*) AS n, {MEANS} FROM ({PER_TRAJ}) p GROUP BY ALL) t
                    USING (movie, roi{_g})) k""",
        ),
    )

register(
    "c9_rois_with_stats",
    "movie:s roi:l n_trajectories:l mean_run_length_um:d",
    lambda s, d: M.per_kymograph(with_roi(s, d), V.rois(s, d), V.movies(s, d)),
    sql_with(
        "fx_nodes fx_movies fx_rois",
        f"""SELECT r.movie, r.roi, count(t.trajectory) AS n_trajectories, avg(t.distance_um) AS mean_run_length_um
            FROM fx_rois r LEFT JOIN ({PER_TRAJ}) t ON t.movie = r.movie AND t.trajectory = r.roi GROUP BY ALL""",
    ),
)

register(
    "d5_aggregate_row",
    "movie:s n_frames:i pixel_size_nm:d frame_interval_ms:d n_trajectories:l total_kymographs:l empty_kymographs:l "
    f"total_time_s:d total_distance_um:d dimensions_px:s dimensions_um:s events_per_min:d events_per_um_per_min:d {MEAN_COLS}",
    lambda s, d: M.aggregate_row(with_roi(s, d), V.rois(s, d), V.movies(s, d)),
    sql_with(
        "fx_nodes fx_movies fx_segments",
        f"""SELECT *, {RATES} FROM (
              SELECT m.*, l.* EXCLUDE (movie, len), t.* EXCLUDE (movie), len * pixel_size_nm / 1000 AS total_distance_um,
                '256, 256' AS dimensions_px, CASE movie WHEN 'm0' THEN '25.60, 25.60' WHEN 'm1' THEN '28.16, 28.16' END AS dimensions_um
              FROM fx_movies m
              JOIN (SELECT movie, sum(len) AS len, count(*) AS total_kymographs,
                      count(*) FILTER (WHERE roi NOT IN (SELECT trajectory FROM fx_points)) AS empty_kymographs
                    FROM ({LENGTHS}) q GROUP BY ALL) l USING (movie)
              JOIN (SELECT movie, count(*) AS n_trajectories, {MEANS} FROM ({PER_TRAJ}) p GROUP BY ALL) t USING (movie)) a""",
    ),
)
