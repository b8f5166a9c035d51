"""Line ROIs: positions along them, matching, editing."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.points import SEGMENTS, K
from checks.registry import register
from checks.views import sql_with
from trackloom.config import KEY
from trackloom.functions import geometry as H
from trackloom.operators import rois as R

LINES = "SELECT movie, roi, max(total) AS total, greatest(floor(max(total)), 2) AS w FROM fx_segments GROUP BY ALL"


def on_line(target: str, source: str) -> str:
    """SQL: rows of ``source`` (with roi and xk) placed on their line as x, y."""
    return f"""
SELECT a.*, s.x0 + u * (s.x1 - s.x0) AS x, s.y0 + u * (s.y1 - s.y0) AS y
FROM (SELECT a.*, s.*, CASE WHEN s.len > 0 THEN greatest(0, least(1, (a.d - s.cum) / s.len)) ELSE 0 END AS u,
        row_number() OVER (PARTITION BY a.rid ORDER BY CASE WHEN a.d < s.cum + s.len THEN 0 ELSE 1 END,
          CASE WHEN a.d < s.cum + s.len THEN s.i ELSE -s.i END) AS pick
      FROM (SELECT b.*, row_number() OVER () AS rid, b.xk / l.w * l.total AS d FROM ({source}) b
            JOIN ({LINES}) l USING (movie, roi)) a
      JOIN (SELECT roi AS sroi, i, x0, y0, x1, y1, len, cum FROM fx_segments) s ON s.sroi = a.roi) a, LATERAL (SELECT a.x0, a.x1, a.y0, a.y1) s
WHERE a.pick = 1"""


def anchors(s, d):
    """Anchors on the ROI with the trajectory's own number; some leave the image or go back."""
    p = V.points(s, d).where("tag = 'signup'")
    back = F.when(F.col("background") == 3, 20).otherwise(0)
    return p.select(
        *KEY,
        F.col("trajectory").alias("roi"),
        F.col("frame").alias("i"),
        (F.col("frame") - back).cast("int").alias("frame"),
        (F.col("search_x") / 2).alias("xk"),
        (511.0 - F.col("frame") + back).alias("yk"),
    )


def ordered_anchors(s, d):
    return anchors(s, d).withColumn("frame", F.col("i")).withColumn("yk", 511.0 - F.col("i"))


ANCHORS = """SELECT movie, trajectory, trajectory AS roi, frame AS i, search_x / 2 AS xk,
  frame - CASE WHEN background = 3 THEN 20 ELSE 0 END AS frame,
  511 - frame + CASE WHEN background = 3 THEN 20 ELSE 0 END AS yk FROM fx_points WHERE tag = 'signup'"""
ORDERED = "SELECT movie, trajectory, trajectory AS roi, frame, search_x / 2 AS xk FROM fx_points WHERE tag = 'signup'"

register(
    "d19_roi_length",
    "movie:s roi:l n_vertices:i length_px:d width:i",
    lambda s, d: R.roi_table(V.rois(s, d)),
    sql_with(
        "fx_segments",
        """SELECT movie, roi, count(*) + 1 AS n_vertices, sum(len) AS length_px, greatest(floor(sum(len)), 2) AS width
           FROM fx_segments GROUP BY ALL""",
    ),
)
register(
    "e14_arc_length",
    "movie:s roi:l i:i arc:d",
    lambda s, d: H.arc_length(V.rois(s, d)),
    sql_with(
        "fx_segments",
        """SELECT movie, roi, i, cum AS arc FROM fx_segments
           UNION ALL SELECT movie, roi, 4, max(total) FROM fx_segments GROUP BY ALL""",
    ),
)
register(
    "h1_roi_point",
    f"{K} frame:i x:d y:d",
    lambda s, d: R.anchors_to_nodes(ordered_anchors(s, d), V.rois(s, d)),
    sql_with("fx_points fx_segments", on_line("h1", ORDERED)),
)

PROJECT = """
SELECT p.*, arg_min(s.cum + p.t * s.len, (p.d2, p.si)) AS along FROM p"""


def projected(source: str, width: str = "l.w") -> str:
    """SQL: kymograph column xk of rows of ``source`` (rid, movie, roi, px, py)."""
    return f"""
SELECT q.rid, any_value(q.movie) AS movie, any_value(q.roi) AS roi,
  arg_min(q.cum + q.t * q.len, row(q.d2, q.i)) / any_value(q.total) * any_value(q.w) AS xk
FROM (SELECT *, (x0 + t * (x1 - x0) - px) ** 2 + (y0 + t * (y1 - y0) - py) ** 2 AS d2
      FROM (SELECT a.rid, a.movie, a.roi, a.px, a.py, s.i, s.x0, s.y0, s.x1, s.y1, s.len, s.cum, l.total, {width} AS w,
              greatest(0, least(1, ((a.px - s.x0) * (s.x1 - s.x0) + (a.py - s.y0) * (s.y1 - s.y0)) / (s.len * s.len))) AS t
            FROM ({source}) a JOIN fx_segments s ON s.roi = a.roi JOIN ({LINES}) l ON l.roi = a.roi
            WHERE s.len > 0) r) q
GROUP BY q.rid"""


register(
    "h2_roi_project",
    f"{K} frame:i xk:d",
    lambda s, d: R.project_points(
        V.points(s, d).withColumn("roi", F.col("trajectory")).where("spot_x is not null"), V.rois(s, d), "spot_x", "spot_y"
    ),
    sql_with(
        "fx_points fx_segments",
        f"""SELECT p.movie, p.trajectory, p.frame, k.xk FROM pts p JOIN ({projected("SELECT * FROM pts")}) k USING (rid)""",
        pts="""SELECT movie, trajectory, frame, trajectory AS roi, spot_x AS px, spot_y AS py,
                 row_number() OVER () AS rid FROM fx_points WHERE spot_x IS NOT NULL""",
    ),
)
register(
    "h3_segment_distance",
    f"{K} frame:i roi_distance:d",
    lambda s, d: R.roi_distance(
        V.points(s, d).select(*KEY, "frame", "search_x", "search_y", F.col("trajectory").alias("roi")).join(
            V.rois(s, d), ["movie", "roi"]
        ),
        "search_x",
        "search_y",
    ),
    sql_with(
        "fx_points fx_segments",
        """SELECT movie, trajectory, frame, min(sqrt((x0 + t * (x1 - x0) - search_x) ** 2 + (y0 + t * (y1 - y0) - search_y) ** 2)) AS roi_distance
           FROM (SELECT p.*, s.x0, s.x1, s.y0, s.y1, coalesce(greatest(0, least(1, ((search_x - x0) * (x1 - x0) +
                   (search_y - y0) * (y1 - y0)) / nullif(len * len, 0))), 0) AS t
                 FROM fx_points p JOIN fx_segments s ON s.roi = p.trajectory) q GROUP BY ALL""",
    ),
)
register(
    "a13_kymo_endpoints",
    f"{K} roi:l start_frame:i start_xk:d end_frame:i end_xk:d",
    lambda s, d: R.kymo_endpoints(
        V.points(s, d).withColumns({"roi": F.col("trajectory"), "px": F.col("search_x"), "py": F.col("search_y")}),
        V.rois(s, d),
    ),
    sql_with(
        "fx_points fx_segments",
        f"""SELECT a.movie, a.trajectory, a.roi, a.frame AS start_frame, ka.xk AS start_xk, z.frame AS end_frame, kz.xk AS end_xk
            FROM ends a JOIN ends z ON a.trajectory = z.trajectory AND a.side = 1 AND z.side = 2
            JOIN proj ka ON ka.rid = a.rid JOIN proj kz ON kz.rid = z.rid""",
        ends="""SELECT *, trajectory * 2 + side AS rid FROM (
                  SELECT movie, trajectory, trajectory AS roi, 1 AS side, min(frame) AS frame, arg_min(search_x, frame) AS px,
                    arg_min(search_y, frame) AS py FROM fx_points GROUP BY ALL
                  UNION ALL
                  SELECT movie, trajectory, trajectory, 2, max(frame), arg_max(search_x, frame), arg_max(search_y, frame)
                  FROM fx_points GROUP BY ALL) e""",
        proj=projected("SELECT * FROM ends"),
    ),
)
register(
    "a8_backfill_nodes",
    f"{K} frame:i x:d y:d",
    lambda s, d: R.backfill_nodes(
        V.nodes(s, d).where("trajectory % 2 = 0"), ordered_anchors(s, d), V.rois(s, d)
    ),
    sql_with(
        "fx_nodes fx_segments",
        f"""SELECT movie, trajectory, frame, x, y FROM fx_nodes WHERE trajectory % 2 = 0
            UNION ALL SELECT movie, trajectory, frame, x, y FROM ({on_line("a8", ORDERED)}) o WHERE trajectory % 2 = 1""",
    ),
)
register(
    "e3_densify_kymo",
    f"{K} frame:i xk:d x:d y:d",
    lambda s, d: R.densify_kymo(ordered_anchors(s, d), V.rois(s, d)),
    sql_with(
        "fx_nodes fx_segments",
        on_line(
            "e3k",
            f"""SELECT movie, trajectory, trajectory AS roi, f AS frame,
                  x0 / 2 + (f - anchor_frame) * 1.0 / (end_frame - anchor_frame) * (x1 - x0) / 2 AS xk
                FROM (SELECT *, unnest(range(start_frame, end_frame + 1)) AS f FROM ({SEGMENTS}) s) r""",
        ),
    ),
)
register(
    "a9_pairs_to_trajectories",
    "movie:s roi:l trajectory:l side:s frame:i x:d y:d",
    lambda s, d: R.pairs_to_trajectories(
        V.points(s, d).select(
            "movie",
            F.col("trajectory").alias("roi"),
            F.col("frame").cast("long").alias("idx"),
            (F.col("search_x") / 2).alias("xk"),
            (F.col("search_y") / 2).alias("y"),
        ),
        V.rois(s, d),
    ),
    sql_with(
        "fx_points fx_segments",
        on_line(
            "a9",
            """SELECT movie, roi, (k - 1) // 2 + 1 AS trajectory, CASE WHEN k % 2 = 1 THEN 'start' ELSE 'end' END AS side,
                 CAST(round_even(y, 0) AS INT) AS frame, xk
               FROM (SELECT movie, trajectory AS roi, search_x / 2 AS xk, search_y / 2 AS y,
                       row_number() OVER (PARTITION BY trajectory ORDER BY frame) AS k FROM fx_points) n""",
        ),
    ),
)
register(
    "b6_validate_anchors",
    f"{K} status:s",
    lambda s, d: R.validate_anchors(anchors(s, d), V.rois(s, d), V.movies(s, d)),
    sql_with(
        "fx_points fx_segments",
        f"""SELECT movie, trajectory, CASE WHEN bool_or(bad) THEN 'Out of bounds' WHEN bool_or(coalesce(frame <= pf, false))
              THEN 'Bad anchor order' ELSE 'ok' END AS status
            FROM (SELECT a.*, frame < 0 OR frame > 511 OR xk < 0 OR xk > l.w OR yk < 0 OR yk > 511 AS bad,
                    lag(frame) OVER (PARTITION BY trajectory ORDER BY i) AS pf
                  FROM ({ANCHORS}) a JOIN ({LINES}) l USING (roi)) b GROUP BY ALL""",
    ),
)
register(
    "a10_kymo_registry",
    "movie:s roi:l channel:i kymograph:s orphaned:b",
    lambda s, d: R.registry_for_channel(R.kymo_registry(V.rois(s, d), V.movies(s, d)), 2),
    sql_with(
        "fx_rois",
        """SELECT movie, roi, 2 AS channel, concat('ch2-', CASE WHEN roi < 1000 THEN lpad(CAST(roi AS VARCHAR), 3, '0')
             ELSE CAST(roi AS VARCHAR) END) AS kymograph, false AS orphaned FROM fx_rois""",
    ),
)
register(
    "a10_next_roi_name",
    "movie:s next_name:s",
    lambda s, d: R.next_roi_name(V.rois(s, d)),
    sql_with("fx_rois", "SELECT movie, printf('%03d', max(roi) + 1) AS next_name FROM fx_rois GROUP BY ALL"),
)


def _deleted(s, d):
    reg = R.kymo_registry(V.rois(s, d), V.movies(s, d))
    names = reg.join(V.points(s, d).select(F.col("trajectory").alias("roi"), "channel"), ["roi", "channel"], "left_semi")
    both = names.unionByName(reg.join(V.points(s, d).where("frame = 0 and tag = 'error'").select(F.col("trajectory").alias("roi")), "roi", "left_semi"))
    return R.delete_kymographs(reg, V.rois(s, d), both)


register(
    "a10_delete_kymographs",
    "movie:s roi:l",
    lambda s, d: _deleted(s, d)[1],
    sql_with(
        "fx_rois fx_points",
        """SELECT movie, roi FROM fx_rois
           WHERE roi NOT IN (SELECT trajectory FROM fx_points WHERE frame = 0 AND tag = 'error')""",
    ),
)


def _traj_geometry(s, d):
    """The line with the trajectory's own number, rebuilt from the number."""
    c = F.col("trajectory")
    ks = F.sequence(F.lit(0), F.lit(4))
    return V.points(s, d).select("movie", "trajectory").distinct().select(
        "movie",
        "trajectory",
        F.lit("polyline").alias("type"),
        F.transform(ks, lambda k: (c * 17 % 256 + k * (c % 5 + 3) * 2).cast("double")).alias("x"),
        F.transform(ks, lambda k: (c * 29 % 256 + k * (c % 7 - 3) * 3).cast("double")).alias("y"),
    )


register(
    "c1_match_geometry",
    f"{K} roi:l",
    lambda s, d: R.match_geometry(_traj_geometry(s, d), V.rois(s, d)),
    sql_with(
        "fx_points fx_rois",
        """SELECT t.movie, t.trajectory, r.roi FROM (SELECT DISTINCT movie, trajectory FROM fx_points) t
           JOIN fx_rois g ON g.roi = t.trajectory JOIN fx_rois r ON r.movie = g.movie AND r.x = g.x AND r.y = g.y""",
    ),
)
ROI_KEY = """
SELECT movie, roi, concat('{"type":"', type, '","x":[', array_to_string(list_transform(x, lambda v: CAST(v AS VARCHAR)), ','),
  '],"y":[', array_to_string(list_transform(y, lambda v: CAST(v AS VARCHAR)), ','), '],"points":[',
  array_to_string(list_transform(range(1, len(x) + 1), lambda i: concat('{"x":', CAST(x[i] AS VARCHAR), ',"y":', CAST(y[i] AS VARCHAR), '}')), ','), ']}') AS key
FROM fx_rois"""
register(
    "h5_roi_key",
    "movie:s roi:l key:s",
    lambda s, d: V.rois(s, d).select("movie", "roi", H.roi_key(F.col("type"), F.col("x"), F.col("y")).alias("key")),
    sql_with("fx_rois", ROI_KEY),
)
register(
    "g1_empty_rois",
    "movie:s roi:l",
    lambda s, d: R.empty_rois(V.rois(s, d), V.points(s, d).withColumn("roi", F.col("trajectory"))),
    sql_with("fx_rois fx_points", "SELECT movie, roi FROM fx_rois WHERE roi NOT IN (SELECT trajectory FROM fx_points)"),
)
def _repeated(s, d):
    """Every line of the first drawing, and every third one drawn again later."""
    r = V.rois(s, d).withColumn("seen", F.col("roi"))
    return r.unionByName(r.where("roi % 3 = 0").withColumn("seen", F.col("roi") + 1_000_000))


register(
    "g3_distinct_rois",
    "movie:s x:s y:s first_seen:l",
    lambda s, d: R.distinct_rois(_repeated(s, d), "seen").select("movie", *[F.transform(c, lambda v: v.cast("int")).cast("string").alias(c) for c in "xy"], "first_seen"),
    sql_with(
        "fx_rois",
        """SELECT movie, CAST(CAST(x AS INT[]) AS VARCHAR) AS x, CAST(CAST(y AS INT[]) AS VARCHAR) AS y, min(roi) AS first_seen FROM fx_rois GROUP BY movie, fx_rois.x, fx_rois.y""",
    ),
)
register(
    "h4_invert_rois",
    "movie:s roi:l i:i x:d y:d",
    lambda s, d: H.vertices(R.invert_rois(V.rois(s, d), V.rois(s, d).where("movie = 'm1'"))),
    sql_with(
        "fx_vertices",
        """SELECT movie, roi, CASE WHEN movie = 'm1' THEN 4 - i ELSE i END AS i, x, y FROM fx_vertices""",
    ),
)
register(
    "h4_invert_anchors",
    f"{K} i:i xk:d",
    lambda s, d: R.invert_anchors(anchors(s, d), V.rois(s, d), V.rois(s, d).where("movie = 'm1'")),
    sql_with(
        "fx_points fx_segments",
        f"""SELECT movie, trajectory, i, CASE WHEN movie = 'm1' THEN l.w - 1 - xk ELSE xk END AS xk
            FROM ({ANCHORS}) a JOIN (SELECT roi, w FROM ({LINES}) q) l USING (roi)""",
    ),
)

SEG_DISTANCE = """sqrt((x0 + t * (x1 - x0) - px) ** 2 + (y0 + t * (y1 - y0) - py) ** 2)"""
T = """coalesce(greatest(0, least(1, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / nullif(len * len, 0))), 0) AS t"""

register(
    "b7_near_roi",
    f"{K} frame:i search_x:d",
    lambda s, d: R.near_roi(V.points(s, d), V.rois(s, d), 1.5, "search_x", "search_y"),
    sql_with(
        "fx_points fx_segments",
        f"""SELECT p.movie, p.trajectory, p.frame, p.search_x FROM fx_points p
            JOIN (SELECT DISTINCT movie, px, py FROM (
                    SELECT p.movie, px, py, x0, y0, x1, y1, {T}
                    FROM (SELECT DISTINCT movie, search_x AS px, search_y AS py FROM fx_points) p
                    JOIN fx_segments s ON s.movie = p.movie AND px BETWEEN least(x0, x1) - 1.5 AND greatest(x0, x1) + 1.5
                      AND py BETWEEN least(y0, y1) - 1.5 AND greatest(y0, y1) + 1.5) q
                  WHERE {SEG_DISTANCE} <= 1.5) h ON h.movie = p.movie AND h.px = p.search_x AND h.py = p.search_y""",
    ),
)


def _ends(s, d):
    return V.points(s, d).groupBy(*KEY).agg(
        *[F.min_by(f"search_{c}", "frame").alias(f"start_{c}") for c in "xy"],
        *[F.max_by(f"search_{c}", "frame").alias(f"end_{c}") for c in "xy"],
    )


register(
    "c2_match_by_place",
    f"{K} roi:l",
    lambda s, d: R.match_by_place(_ends(s, d), V.rois(s, d), 12.0),
    sql_with(
        "fx_points fx_segments",
        f"""SELECT movie, trajectory, roi FROM (
              SELECT p.movie, trajectory, side, roi, px, py, x0, y0, x1, y1, {T}
              FROM ends p JOIN fx_segments s ON s.movie = p.movie) q
            WHERE {SEG_DISTANCE} <= 12 GROUP BY ALL HAVING count(DISTINCT side) = 2""",
        ends="""SELECT movie, trajectory, 1 AS side, arg_min(search_x, frame) AS px, arg_min(search_y, frame) AS py FROM fx_points GROUP BY ALL
                UNION ALL SELECT movie, trajectory, 2, arg_max(search_x, frame), arg_max(search_y, frame) FROM fx_points GROUP BY ALL""",
    ),
)
