"""Tracking modes over the pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.images import MEAS, SOFT, WK, measure_sql
from checks.lines import on_line
from checks.motion import FILLED, SAVGOL
from checks.points import SPEED
from checks.registry import register
from checks.views import sql_with
from trackloom.plans import tracking as T
from trackloom.plans.recompute import recompute


def _windows(s, d):
    """The windows as trajectories of one channel each."""
    return V.windows(s, d).withColumn("trajectory", F.col("trajectory") * 2 + F.col("channel"))


FIT = "spot_x spot_y sigma peak background intensity".split()
WIN = "SELECT * EXCLUDE (trajectory), trajectory * 2 + channel AS trajectory FROM fx_windows"


def _nodes(s, d):
    return _windows(s, d).select("movie", "trajectory", "frame", F.col("search_x").alias("x"), F.col("search_y").alias("y"))


def _dense(s, d):
    tr = _windows(s, d).select("movie", "trajectory", "channel").distinct()
    return T.search_windows(_nodes(s, d), tr)


DENSE = f"""SELECT w.* FROM ({WIN}) w
  JOIN (SELECT movie, trajectory FROM ({WIN}) q GROUP BY ALL HAVING count(*) > 1) n USING (movie, trajectory)"""

register(
    "i7_track_fixed",
    f"{WK} {MEAS}",
    lambda s, d: T.track_fixed(_windows(s, d), V.pixels(s, d), V.pixel_movies(s, d), SOFT),
    sql_with("fx_windows fx_pixels", f"SELECT * FROM ({measure_sql(WIN, 2.0)}) m"),
)
register(
    "i4_track_independent",
    f"{WK} search_x:d search_y:d spot_x:d spot_y:d sigma:d peak:d intensity:d",
    lambda s, d: T.track_independent(_dense(s, d), V.pixels(s, d), V.pixel_movies(s, d), SOFT, avoid=True),
    sql_with(
        "fx_windows fx_pixels",
        f"""SELECT m.movie, m.channel, m.frame, m.trajectory, search_x, search_y,
              CASE WHEN t.frame IS NULL THEN spot_x END AS spot_x, CASE WHEN t.frame IS NULL THEN spot_y END AS spot_y,
              CASE WHEN t.frame IS NULL THEN sigma END AS sigma, CASE WHEN t.frame IS NULL THEN peak END AS peak,
              CASE WHEN t.frame IS NULL THEN intensity END AS intensity
            FROM meas m LEFT JOIN (SELECT DISTINCT a.movie, a.trajectory, a.frame FROM meas a JOIN meas b
                ON a.movie = b.movie AND a.frame = b.frame AND b.trajectory < a.trajectory
                AND (a.spot_x - b.spot_x) ** 2 + (a.spot_y - b.spot_y) ** 2 < 36) t USING (movie, trajectory, frame)""",
        meas=measure_sql(DENSE, 2.0),
    ),
)
register(
    "i6_track_smooth",
    f"{WK} {MEAS}",
    lambda s, d: T.track_smooth(_windows(s, d), V.pixels(s, d), V.pixel_movies(s, d), SOFT),
    sql_with(
        "fx_windows fx_pixels",
        f"""SELECT movie, channel, frame, m.trajectory // 2 AS trajectory, m.search_x, m.search_y,
              {", ".join(f"CASE WHEN f.frame IS NULL THEN m.{c} ELSE g.{c} END AS {c}" for c in FIT)}
            FROM fx_points m LEFT JOIN flags f USING (movie, channel, trajectory, frame)
            LEFT JOIN again g USING (movie, channel, trajectory, frame)""",
        # The smoothing texts tell trajectories apart by their number alone.
        fx_points=f"SELECT * REPLACE (trajectory * 2 + CAST(movie = 'm1' AS INT) AS trajectory) FROM ({measure_sql(WIN, 2.0)}) m",
        filled=FILLED,
        sav=SAVGOL,
        flags="""SELECT v.movie, s.channel, v.trajectory, v.frame, smooth_x AS search_x, smooth_y AS search_y, CAST(ceil(4 * sg) AS BIGINT) AS crop
            FROM sav v JOIN (SELECT trajectory, any_value(channel) AS channel, avg(sigma) AS sg, count(spot_x) AS fits FROM fx_points GROUP BY trajectory) s
              ON s.trajectory = v.trajectory
            WHERE fits >= 2 AND sqrt((fill_x - smooth_x) ** 2 + (fill_y - smooth_y) ** 2) > least(3, 2 * sg)""",
        again=measure_sql("SELECT * FROM flags", 2.0, crop_column=True),
    ),
)
#: The walk, one frame of every trajectory at a time: measured at the centre reached, which is then blended.
WALK = f"""
SELECT * EXCLUDE (pos) FROM (
  WITH RECURSIVE ordered AS (
    SELECT *, row_number() OVER (PARTITION BY movie, trajectory ORDER BY frame) AS pos FROM ({WIN}) q),
  walk AS (
    SELECT movie, channel, frame, trajectory, search_x, search_y, 0 AS pos, search_x AS track_x, search_y AS track_y,
      CAST(NULL AS DOUBLE) AS spot_x, CAST(NULL AS DOUBLE) AS spot_y, CAST(NULL AS DOUBLE) AS sigma,
      CAST(NULL AS DOUBLE) AS peak, CAST(NULL AS DOUBLE) AS background, CAST(NULL AS DOUBLE) AS intensity
    FROM ordered WHERE pos = 1
    UNION ALL
    SELECT movie, channel, frame, trajectory, ix, iy, pos,
      CASE WHEN spot_x IS NULL THEN (search_x + ix) / 2 ELSE k * spot_x + (1 - k) * ix END,
      CASE WHEN spot_x IS NULL THEN (search_y + iy) / 2 ELSE k * spot_y + (1 - k) * iy END,
      spot_x, spot_y, sigma, peak, background, intensity
    FROM (SELECT m.*, o.pos, o.search_x AS ix, o.search_y AS iy,
            exp(-0.5 * sqrt((spot_x - o.search_x) ** 2 + (spot_y - o.search_y) ** 2) / 12) AS k
          FROM ({measure_sql("""SELECT o.movie, o.channel, o.frame, o.trajectory, t.track_x AS search_x, t.track_y AS search_y
            FROM ordered o JOIN walk t ON t.movie = o.movie AND t.trajectory = o.trajectory AND o.pos = t.pos + 1""", 2.0)}) m
          JOIN ordered o USING (movie, channel, frame, trajectory)) s)
  SELECT * FROM walk WHERE pos > 0) r"""
register(
    "i5_track_sequential",
    f"{WK} search_x:d search_y:d track_x:d track_y:d spot_x:d spot_y:d sigma:d peak:d background:d intensity:d",
    lambda s, d: T.track_sequential(_windows(s, d), V.pixels(s, d), V.pixel_movies(s, d), SOFT),
    sql_with("fx_windows fx_pixels", WALK),
)


def _recomputed(s, d):
    """Points measured anew at their own centres, as no trajectory has anchors or nodes."""
    w = _windows(s, d)
    none = _nodes(s, d).limit(0)
    anchors = none.select("movie", "trajectory", "frame", F.lit(0).cast("long").alias("roi"), F.col("x").alias("xk"))
    lines = V.pixel_rois(s, d)
    own = w.select("movie", "trajectory", "frame", "search_x", "search_y")
    trs = w.select("movie", "trajectory", "channel").distinct()
    return recompute(anchors, lines, none, own, trs, V.pixels(s, d), V.pixel_movies(s, d), "same-centre", SOFT, background=False)


register(
    "i12_recompute",
    f"{WK} spot_x:d intensity:d speed:d",
    _recomputed,
    sql_with("fx_windows fx_pixels", SPEED, fx_points=measure_sql(WIN, 2.0)),
)


def _by_kind(s, d):
    """Windows by what their trajectory has: anchors at both ends of a line (0), nodes at both ends (1), points only (2)."""
    kind = F.floor(F.col("trajectory") / 2)
    return _windows(s, d).withColumns({"kind": kind % 3, "roi": 2 * (kind % 5) + F.when(F.col("movie") == "m0", 2).otherwise(1)})


def _both_ends(w):
    ends = w.groupBy("movie", "trajectory", "roi").agg(
        F.array(*[fn(F.struct("frame", F.col("search_x").alias("x"), F.col("search_y").alias("y")), "frame") for fn in (F.min_by, F.max_by)]).alias("e")
    )
    return ends.select("movie", "trajectory", "roi", F.inline("e"))


def _recomputed_from_all(s, d):
    w = _by_kind(s, d)
    anchors = _both_ends(w.where("kind = 0")).select("movie", "trajectory", "roi", "frame", (F.col("x") / 4).alias("xk"))
    nodes = _both_ends(w.where("kind = 1")).select("movie", "trajectory", "frame", "x", "y")
    own = w.select("movie", "trajectory", "frame", "search_x", "search_y")
    trs = w.select("movie", "trajectory", "channel").distinct()
    return recompute(anchors, V.pixel_rois(s, d), nodes, own, trs, V.pixels(s, d), V.pixel_movies(s, d), "independent", SOFT, background=False)


def _between(value: str) -> str:
    """SQL: ``value`` of a trajectory's first window, linearly to that of its last one."""
    return f"a{value} + (frame - f0) * 1.0 / (f1 - f0) * (z{value} - a{value})"


register(
    "i12_recompute_from_all",
    f"{WK} search_x:d search_y:d spot_x:d intensity:d speed:d",
    _recomputed_from_all,
    sql_with(
        "fx_windows fx_pixels",
        SPEED,
        fx_vertices="""SELECT concat('m', s_suppkey % 2) AS movie, s_suppkey AS roi, k AS i,
              CAST((s_suppkey * 7 + k * (s_suppkey % 3 + 1) * 5) % 64 AS DOUBLE) AS x,
              CAST((s_suppkey * 3 + k * (s_suppkey % 4 + 1) * 2) % 20 AS DOUBLE) AS y
            FROM (SELECT *, unnest(range(0, 3)) AS k FROM supplier) q""",
        fx_segments=V.SQL["fx_segments"],
        kinds=f"""SELECT *, trajectory // 2 % 3 AS kind, 2 * (trajectory // 2 % 5) + CASE movie WHEN 'm0' THEN 2 ELSE 1 END AS roi FROM ({WIN}) q""",
        spans="""SELECT *, unnest(range(f0, f1 + 1)) AS frame FROM (
              SELECT movie, channel, trajectory, kind, roi, min(frame) AS f0, max(frame) AS f1, arg_min(search_x, frame) AS ax,
                arg_max(search_x, frame) AS zx, arg_min(search_y, frame) AS ay, arg_max(search_y, frame) AS zy FROM kinds GROUP BY ALL) q""",
        centres=f"""SELECT movie, channel, frame, trajectory, x AS search_x, y AS search_y FROM (
              {on_line("centres", f"SELECT movie, channel, trajectory, frame, roi, ({_between('x')}) / 4 AS xk FROM spans WHERE kind = 0")}) l
            UNION ALL SELECT movie, channel, frame, trajectory, {_between('x')}, {_between('y')} FROM spans WHERE kind = 1
            UNION ALL SELECT movie, channel, frame, trajectory, search_x, search_y FROM kinds WHERE kind = 2""",
        fx_points=measure_sql("SELECT movie, channel, CAST(frame AS INT) AS frame, trajectory, search_x, search_y FROM centres", 2.0),
    ),
)
