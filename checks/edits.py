"""Custom fields, selections, imports, drift, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.motion import FITS, G2, G3, SEG_FITS, fit_sql, msd_sql
from checks.points import SPEED, K
from checks.registry import register
from checks.views import sql_with
from trackloom.config import KEY
from trackloom.operators import diffusion as D
from trackloom.operators import drift as R
from trackloom.operators import editing as E
from trackloom.operators import histograms as H
from trackloom.operators import points as P
from trackloom.sources import tables as T


def _trajectories(s, d):
    """One row per trajectory with a few custom fields."""
    t = F.col("trajectory")
    return V.points(s, d).select(*KEY).distinct().withColumn(
        "custom",
        F.create_map(
            F.lit("group"),
            F.concat(F.lit("g"), (t % 5).cast("string")),
            F.lit("good"),
            F.when((t % 3 == 1) | (t % 2 == 0), "Yes").otherwise(""),
        ),
    )


def _picked(s, d):
    """Trajectories with an early purchase."""
    return V.points(s, d).where("tag = 'purchase' and frame < 3")


PICKED = "SELECT DISTINCT trajectory FROM fx_points WHERE tag = 'purchase' AND frame < 3"
GOOD = "trajectory % 3 = 1 OR trajectory % 2 = 0"

register(
    "b14_toggle_binary",
    f"{K} good:s",
    lambda s, d: E.toggle_binary(_trajectories(s, d), "good", _picked(s, d)).withColumn("good", F.nullif(F.col("custom")["good"], F.lit(""))),
    sql_with(
        "fx_points",
        f"""SELECT movie, trajectory, CASE WHEN trajectory NOT IN ({PICKED}) THEN CASE WHEN {GOOD} THEN 'Yes' END
              WHEN a.every THEN NULL ELSE 'Yes' END AS good
            FROM (SELECT DISTINCT movie, trajectory FROM fx_points) t
            JOIN (SELECT movie, bool_and({GOOD}) AS every FROM fx_points WHERE trajectory IN ({PICKED}) GROUP BY ALL) a USING (movie)""",
    ),
)
register(
    "b15_set_value",
    f"{K} grp:s",
    lambda s, d: E.set_value(_trajectories(s, d), "group", _picked(s, d), "x").withColumn("grp", F.col("custom")["group"]),
    sql_with(
        "fx_points",
        f"""SELECT movie, trajectory, CASE WHEN trajectory IN ({PICKED}) THEN 'x' ELSE concat('g', trajectory % 5) END AS grp
            FROM (SELECT DISTINCT movie, trajectory FROM fx_points) t""",
    ),
)
register(
    "b15_add_remove_column",
    f"{K} fields:i",
    lambda s, d: E.remove_column(E.add_column(E.add_column(_trajectories(s, d), "note"), "good"), "group").withColumn("fields", F.size("custom")),
    sql_with("fx_points", "SELECT DISTINCT movie, trajectory, 2 AS fields FROM fx_points"),
)


def _wide(s, d):
    t = F.col("trajectory")
    return V.points(s, d).select(*KEY).distinct().withColumns(
        {
            "Speed class [value]": (t % 4).cast("double"),
            "Good [binary]": F.when(t % 2 == 0, "Yes"),
            "Note": F.when(t % 3 == 0, F.lit("n")).when(t % 3 == 1, F.lit(" ")),
            "Ch. 2 co. %": t * 0.5,
            "Ch. 9 co. %": t * 0.5,
        }
    )


register(
    "b13_read_custom_columns",
    f"{K} name:s value:s",
    lambda s, d: E.long_custom_columns(E.read_custom_columns(_wide(s, d), KEY, 2)),
    sql_with(
        "fx_points",
        """SELECT * FROM (
             SELECT movie, trajectory, 'Speed class' AS name, CAST(trajectory % 4 AS VARCHAR) AS value FROM t
             UNION ALL SELECT movie, trajectory, 'Good', 'Yes' FROM t WHERE trajectory % 2 = 0
             UNION ALL SELECT movie, trajectory, 'Note', 'n' FROM t WHERE trajectory % 3 = 0
             UNION ALL SELECT movie, trajectory, 'Ch. 2 co. %',
               CASE WHEN trajectory % 2 = 0 THEN CAST(trajectory // 2 AS VARCHAR) ELSE concat(trajectory // 2, '.5') END FROM t) u""",
        t="SELECT DISTINCT movie, trajectory FROM fx_points",
    ),
)
register(
    "b17_find_missing",
    K,
    lambda s, d: E.find_missing(V.points(s, d), D.diffusion(V.points(s, d), V.movies(s, d), min_pairs=30)),
    sql_with(
        "fx_points fx_movies",
        f"""SELECT DISTINCT movie, trajectory FROM fx_points
            WHERE trajectory NOT IN (SELECT trajectory FROM ({fit_sql(msd_sql(FITS, G2, 10, 30), G2)}) f)""",
    ),
)
register(
    "b17_missing_segment_diffusion",
    K,
    lambda s, d: E.missing_segment_diffusion(V.points(s, d), V.nodes(s, d), D.diffusion_by_segment(V.points(s, d), V.nodes(s, d), V.movies(s, d), max_lag=4, min_pairs=5)),
    sql_with(
        "fx_nodes fx_movies",
        f"""SELECT DISTINCT movie, trajectory FROM fx_points
            WHERE trajectory IN (SELECT trajectory FROM fx_nodes GROUP BY ALL HAVING count(*) > 1)
              AND trajectory NOT IN (SELECT trajectory FROM ({fit_sql(msd_sql(SEG_FITS, G3, 4, 5), G3)}) f)""",
    ),
)


def _shares(s, d):
    """Shares of two channels; the second one is missing in places."""
    t = F.col("trajectory")
    return V.points(s, d).select(*KEY).distinct().withColumns({"ch1_pct": F.when(t % 5 != 1, 50.0), "ch2_pct": F.when(t % 4 != 2, 25.0)})


register(
    "b17_missing_colocalisation",
    K,
    lambda s, d: E.missing_colocalisation(V.points(s, d).select(*KEY, "channel").distinct(), _shares(s, d), V.movies(s, d).withColumn("n_channels", F.when(F.col("movie") == "m1", 1).otherwise(2))),
    sql_with(
        "fx_points",
        """SELECT DISTINCT movie, trajectory FROM fx_points WHERE movie <> 'm1'
             AND ((channel <> 1 AND trajectory % 5 = 1) OR (channel <> 2 AND trajectory % 4 = 2))""",
    ),
)
register(
    "b17_missing_steps",
    K,
    lambda s, d: E.missing_steps(V.points(s, d), V.points(s, d).select(*KEY, "frame", F.when(F.col("trajectory") % 3 != 0, F.col("intensity")).alias("level"))),
    sql_with("fx_points", "SELECT DISTINCT movie, trajectory FROM fx_points WHERE trajectory NOT IN (SELECT trajectory FROM fx_points WHERE trajectory % 3 <> 0 AND intensity IS NOT NULL)"),
)
register(
    "g2_to_compute",
    K,
    lambda s, d: E.to_compute(
        E.find_missing(V.points(s, d), D.diffusion(V.points(s, d), V.movies(s, d), min_pairs=30)),
        E.find_missing(V.points(s, d), V.nodes(s, d).where("frame > 50")),
    ),
    sql_with(
        "fx_nodes fx_movies",
        f"""SELECT DISTINCT movie, trajectory FROM fx_points
            WHERE trajectory NOT IN (SELECT trajectory FROM ({fit_sql(msd_sql(FITS, G2, 10, 30), G2)}) f)
              OR trajectory NOT IN (SELECT trajectory FROM fx_nodes WHERE frame > 50)""",
    ),
)
register(
    "d23_category_codes",
    "value:s first_seen:l code:i",
    lambda s, d: E.category_codes(V.table(s, d, "events"), "props", "event_id"),
    """SELECT value, first_seen, CAST((row_number() OVER (ORDER BY first_seen) - 1) % 38 AS INT) AS code
       FROM (SELECT props AS value, min(event_id) AS first_seen FROM events GROUP BY ALL) f""",
)
register(
    "f3_next_ids",
    "movie:s id:l trajectory:l",
    lambda s, d: E.next_ids(
        V.points(s, d).where("movie <> 'm2'"),
        V.rois(s, d).select("movie", F.col("roi").alias("id")),
        "id",
    ),
    sql_with(
        "fx_points fx_rois",
        """SELECT r.movie, r.roi AS id, coalesce(t.top, 0) + row_number() OVER (PARTITION BY r.movie ORDER BY r.roi) AS trajectory
           FROM fx_rois r LEFT JOIN (SELECT movie, max(trajectory) AS top FROM fx_points WHERE movie <> 'm2' GROUP BY ALL) t USING (movie)""",
    ),
)
register(
    "f2_sorted_points",
    f"{K} frame:i search_x:d",
    lambda s, d: P.ordered(V.points(s, d)),
    sql_with("fx_points", "SELECT * FROM fx_points ORDER BY movie, trajectory, frame"),
)

HIST = f"""
SELECT movie, trajectory, bins, low, high, mean_speed, CAST(least(floor((v - low) * bins / (high - low)), bins - 1) AS INT) AS bin, count(*) AS points
FROM (SELECT *, CASE WHEN z > a THEN a ELSE a - 0.5 END AS low, CASE WHEN z > a THEN z ELSE z + 0.5 END AS high,
        CASE WHEN z > a THEN CAST(ceil((z - a) / CASE WHEN q3 > q1 THEN least((z - a) / (log2(n) + 1), 2 * (q3 - q1) / n ** (1.0 / 3)) ELSE (z - a) / (log2(n) + 1) END) AS INT) ELSE 1 END AS bins
      FROM (SELECT *, min(v) OVER w AS a, max(v) OVER w AS z, count(*) OVER w AS n, avg(v) OVER w AS mean_speed,
              quantile_cont(v, 0.25) OVER w AS q1, quantile_cont(v, 0.75) OVER w AS q3
            FROM (SELECT movie, trajectory, speed * coalesce(pixel_size_nm / frame_interval_ms, 1) AS v FROM ({SPEED}) s JOIN fx_movies USING (movie) WHERE speed IS NOT NULL) t
            WINDOW w AS (PARTITION BY movie, trajectory)) u) x
GROUP BY ALL"""
register(
    "d15_speed_histogram",
    f"{K} bins:i low:d high:d mean_speed:d bin:i points:l",
    lambda s, d: H.speed_histogram(P.speeds(V.points(s, d)), V.movies(s, d)),
    sql_with("fx_points fx_movies", HIST),
)

# Imports of text

DESC = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('ImageJ Voxel size: 0.1x0.', event_id % 50, 'x1 finterval=0.', event_id % 7, ' end')
  WHEN 1 THEN concat('unit=um finterval=', event_id % 3) ELSE 'none' END AS description,
  CASE event_id % 5 WHEN 0 THEN concat(event_id % 100 * 1000, '/', 100) WHEN 1 THEN concat('0.', event_id % 30) END AS y_resolution FROM events"""


def _meta(s, d):
    e = F.col("event_id")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    return V.table(s, d, "events").select(
        "event_id",
        F.when(e % 4 == 0, text("ImageJ Voxel size: 0.1x0.", e % 50, "x1 finterval=0.", e % 7, " end"))
        .when(e % 4 == 1, text("unit=um finterval=", e % 3))
        .otherwise("none")
        .alias("description"),
        F.when(e % 5 == 0, text(e % 100 * 1000, "/", F.lit(100))).when(e % 5 == 1, text("0.", e % 30)).alias("y_resolution"),
    )


register(
    "a3_extract_scale",
    "event_id:l pixel_size_nm:d frame_interval_ms:d",
    lambda s, d: T.extract_scale(_meta(s, d)),
    f"""SELECT event_id, CASE WHEN ps >= 0.1 THEN ps END AS pixel_size_nm, CASE WHEN fi >= 0.1 THEN fi END AS frame_interval_ms
        FROM (SELECT event_id, coalesce(TRY_CAST(regexp_extract(description, 'Voxel size:\\s*([0-9.]+)[xX]([0-9.]+)[xX]', 2) AS DOUBLE) * 1000,
                CASE WHEN y_resolution LIKE '%/%' THEN TRY_CAST(split_part(y_resolution, '/', 2) AS DOUBLE) * 1000 / nullif(TRY_CAST(split_part(y_resolution, '/', 1) AS DOUBLE), 0)
                  ELSE TRY_CAST(y_resolution AS DOUBLE) * 1000 END) AS ps,
                TRY_CAST(regexp_extract(description, 'finterval=([0-9.]+)', 1) AS DOUBLE) * 1000 AS fi
              FROM ({DESC}) d) q""",
)


def _spot_text(s, d):
    p = V.points(s, d)
    bad = F.when(F.col("tag") == "error", "n/a")
    return p.select(
        F.col("trajectory").cast("string").alias("TRACK_ID"),
        (F.col("frame") + 1).cast("string").alias("FRAME"),
        F.coalesce(bad, (F.col("search_x") * 0.25).cast("string")).alias("POSITION_X"),
        (F.col("search_y") * 0.25).cast("string").alias("POSITION_Y"),
    )


register(
    "a4_spots_to_nodes",
    "trajectory:l frame:i x:d y:d source:s",
    lambda s, d: T.spots_to_nodes(_spot_text(s, d), 250.0),
    sql_with("fx_points", "SELECT trajectory, frame, search_x AS x, search_y AS y, 'trackmate' AS source FROM fx_points WHERE tag <> 'error'"),
)


def _legacy(s, d):
    """A per-trajectory table with old headers and JSON cells, some of them bad."""
    t = F.col("trajectory")
    zero = F.when(t % 4 == 0, 0).otherwise(3)
    return V.points(s, d).select("movie", "trajectory").distinct().select(
        F.col("movie").alias("Movie"),
        t.cast("string").alias("Trajectory"),
        F.lit("1").alias("Start_Frame"),
        F.lit("64").alias("End_Frame"),
        F.when(t % 5 == 0, "[[1,").otherwise(F.format_string("[[2, %d.5, 7.0], [3]]", t)).alias("Anchors"),
        F.format_string('{"type": "line", "x": [0.0, %d.0], "y": [1.0, 2.0], "points": [[0.0, 1.0]]}', t).alias("ROI"),
        F.format_string("[[%d.0, 2.0, %d], [4.0, 5.0, 9]]", t, zero).alias("Nodes"),
    )


register(
    "a5_import_trajectories",
    f"{K} start_frame:i end_frame:i",
    lambda s, d: T.import_trajectories(_legacy(s, d)),
    sql_with("fx_points", "SELECT DISTINCT movie, trajectory, 1 AS start_frame, 64 AS end_frame FROM fx_points"),
)
register(
    "a6_parse_geometry",
    f"{K} n_anchors:i xk:d roi_x1:d",
    lambda s, d: T.parse_geometry(T.import_trajectories(_legacy(s, d))).select(
        *KEY, F.size("anchors").alias("n_anchors"), F.get("anchors", F.lit(0))["xk"].alias("xk"), F.col("roi.x")[1].alias("roi_x1")
    ),
    sql_with(
        "fx_points",
        """SELECT DISTINCT movie, trajectory, CASE WHEN trajectory % 5 = 0 THEN 0 ELSE 1 END AS n_anchors,
             CASE WHEN trajectory % 5 <> 0 THEN trajectory + 0.5 END AS xk, trajectory AS roi_x1 FROM fx_points""",
    ),
)
register(
    "a7_node_frame_base",
    f"{K} frame:i x:d y:d",
    lambda s, d: T.nodes_of(T.parse_geometry(T.import_trajectories(_legacy(s, d)))),
    sql_with(
        "fx_points",
        """SELECT movie, trajectory, CASE WHEN trajectory % 4 = 0 THEN 0 ELSE 2 END AS frame, trajectory AS x, 2 AS y FROM t
           UNION ALL SELECT movie, trajectory, CASE WHEN trajectory % 4 = 0 THEN 9 ELSE 8 END, 4, 5 FROM t""",
        t="SELECT DISTINCT movie, trajectory FROM fx_points",
    ),
)
register(
    "h6_geometry_json",
    f"{K} movie_anchors:s",
    lambda s, d: T.geometry_json(T.parse_geometry(T.import_trajectories(_legacy(s, d)))),
    sql_with(
        "fx_points",
        """SELECT DISTINCT movie, trajectory, CASE WHEN trajectory % 4 = 0 THEN concat('[[', trajectory, '.0,2.0,1.0],[4.0,5.0,10.0]]')
             ELSE concat('[[', trajectory, '.0,2.0,3.0],[4.0,5.0,9.0]]') END AS movie_anchors FROM fx_points""",
    ),
)

# Drift: every trajectory is the reference path of its own movie; its second row has a fit by construction.


def _path(s, d):
    p = V.points(s, d)
    ref = F.col("frame") == 1
    return p.select(
        *KEY,
        "frame",
        F.when(ref, F.col("search_x")).otherwise(F.col("spot_x")).alias("x"),
        F.when(ref, F.col("search_y")).otherwise(F.col("spot_y")).alias("y"),
    )


register(
    "e12_drift_offsets",
    f"{K} frame:i dx:d dy:d",
    lambda s, d: R.drift_offsets(_path(s, d), 1, KEY, block=8),
    sql_with(
        "fx_points",
        """SELECT movie, trajectory, frame, x - rx AS dx, y - ry AS dy FROM walk
           JOIN (SELECT trajectory, x AS rx, y AS ry FROM p WHERE frame = 1) r USING (trajectory)
           WHERE NOT (frame = 1 AND side = -1)""",
        p="""SELECT movie, trajectory, frame, CASE WHEN frame = 1 THEN search_x ELSE spot_x END AS x,
               CASE WHEN frame = 1 THEN search_y ELSE spot_y END AS y FROM fx_points""",
        sides="""SELECT *, row_number() OVER (PARTITION BY trajectory, side ORDER BY abs(frame - 1)) AS i FROM (
                   SELECT *, 1 AS side FROM p WHERE frame >= 1 UNION ALL SELECT *, -1 FROM p WHERE frame <= 1) u""",
        walk="""SELECT movie, trajectory, side, i, frame, x, y, 0::DOUBLE AS ux, 0::DOUBLE AS uy FROM sides WHERE i = 1
                UNION ALL
                SELECT n.movie, n.trajectory, n.side, n.i, n.frame, coalesce(n.x, w.x + w.ux), coalesce(n.y, w.y + w.uy),
                  CASE WHEN n.x IS NULL THEN w.ux ELSE n.x - w.x END, CASE WHEN n.x IS NULL THEN w.uy ELSE n.y - w.y END
                FROM walk w JOIN sides n ON n.trajectory = w.trajectory AND n.side = w.side AND n.i = w.i + 1""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
