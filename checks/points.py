"""Per-point queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import register
from checks.views import sql_with
from trackloom.config import KEY
from trackloom.functions import scalars as S
from trackloom.operators import points as P
from trackloom.operators import segments as G

K = "movie:s trajectory:l"

SPEED = """
SELECT *, sqrt((spot_x - px) * (spot_x - px) + (spot_y - py) * (spot_y - py)) AS speed
FROM (SELECT *, lag(spot_x) OVER w AS px, lag(spot_y) OVER w AS py FROM fx_points
      WINDOW w AS (PARTITION BY movie, trajectory ORDER BY frame)) s"""

register(
    "e1_speeds",
    f"{K} frame:i speed:d",
    lambda s, d: P.speeds(V.points(s, d)),
    sql_with("fx_points", SPEED),
)

register(
    "b1_normalise_points",
    f"{K} frame:i search_x:d search_y:d orig_x:d orig_y:d",
    lambda s, d: P.normalise_points(
        V.points(s, d).withColumns(
            {
                "orig_x": F.col("spot_x"),
                "orig_y": F.col("spot_y"),
                "search_x": F.when(F.col("tag") != "view", F.col("search_x")),
                "search_y": F.when(F.col("tag") != "view", F.col("search_y")),
            }
        )
    ),
    sql_with(
        "fx_points",
        """SELECT movie, trajectory, frame, coalesce(sx, spot_x) AS search_x, coalesce(sy, spot_y) AS search_y,
             coalesce(spot_x, sx) AS orig_x, coalesce(spot_y, sy) AS orig_y
           FROM (SELECT *, CASE WHEN tag <> 'view' THEN search_x END AS sx,
                   CASE WHEN tag <> 'view' THEN search_y END AS sy FROM fx_points) p""",
    ),
)

register(
    "b2_resolve_channel",
    f"{K} channel:i mixed:b n_bad:l",
    lambda s, d: P.resolve_channel(
        V.points(s, d).withColumn("channel", (F.col("channel") + F.col("background") % 3 - 1).cast("int")), 2
    ),
    sql_with(
        "fx_points",
        """SELECT movie, trajectory, min(c) FILTER (WHERE c BETWEEN 1 AND 2) AS channel, count(DISTINCT c) > 1 AS mixed,
             count(*) FILTER (WHERE c NOT BETWEEN 1 AND 2) AS n_bad
           FROM (SELECT *, CAST(channel + background % 3 - 1 AS INT) AS c FROM fx_points) p GROUP BY ALL""",
    ),
)

register(
    "b3_valid_points",
    f"{K} frame:i intensity:d",
    lambda s, d: P.valid_points(V.points(s, d)),
    sql_with("fx_points", "SELECT * FROM fx_points WHERE intensity > 0"),
)

register(
    "b4_with_units",
    f"{K} frame:i speed:d speed_um_s:d speed_um_min:d",
    lambda s, d: P.with_units(P.speeds(V.points(s, d)), V.movies(s, d)),
    sql_with(
        "fx_points fx_movies",
        f"""SELECT v.*, speed * pixel_size_nm / frame_interval_ms AS speed_um_s,
              speed * pixel_size_nm / frame_interval_ms * 60 AS speed_um_min
            FROM ({SPEED}) v JOIN fx_movies m USING (movie)""",
    ),
)

register(
    "b5_format_table",
    f"{K} frame:i intensity:d spot_x:d peak:d",
    lambda s, d: P.format_table(
        V.points(s, d).withColumn("intensity", F.col("intensity") / 7), {"intensity": 4, "spot_x": 1, "peak": 1}
    ),
    sql_with(
        "fx_points",
        """SELECT movie, trajectory, frame, round(intensity / 7, 4) AS intensity,
             floor(spot_x * 10 + 0.5) / 10 AS spot_x, round(peak, 1) AS peak FROM fx_points""",
    ),
)

register(
    "b10_classify_diffusion",
    f"{K} frame:i alpha_class:s d_class:s",
    lambda s, d: P.classify_diffusion(
        V.points(s, d).withColumns({"alpha": F.col("intensity") / 500, "d_um2_s": F.col("peak") / 50})
    ),
    sql_with(
        "fx_points",
        """SELECT movie, trajectory, frame,
             CASE WHEN a IS NULL THEN 'N/A' WHEN a < 0.5 THEN 'α < 0.5  (confined)' WHEN a < 0.9 THEN '0.5–0.9  (subdiff.)'
               WHEN a < 1.1 THEN '0.9–1.1  (Brownian)' WHEN a < 1.5 THEN '1.1–1.5  (superdiff.)' ELSE 'α ≥ 1.5  (directed)' END AS alpha_class,
             CASE WHEN d IS NULL THEN 'N/A' WHEN d < 0.01 THEN 'D < 0.01 μm²/s' WHEN d < 0.1 THEN '0.01–0.1 μm²/s'
               WHEN d < 1 THEN '0.1–1 μm²/s' ELSE 'D ≥ 1 μm²/s' END AS d_class
           FROM (SELECT *, intensity / 500 AS a, peak / 50 AS d FROM fx_points) p""",
    ),
)

register(
    "b12_fixed_background",
    f"{K} fixed_background:d",
    lambda s, d: P.fixed_background(
        V.points(s, d)
        .withColumn("from_trajectory", F.when(F.col("trajectory") % 7 == 0, F.lit("no")).otherwise(F.lit(" Yes")))
        .withColumn("background", F.when(F.col("tag") != "view", (F.col("trajectory") % 5).cast("double")))
    ),
    sql_with(
        "fx_points",
        """SELECT movie, trajectory,
             CASE WHEN bool_and(f = 'yes') AND count(DISTINCT b) = 1 THEN any_value(b) END AS fixed_background
           FROM (SELECT movie, trajectory, CASE WHEN trajectory % 7 = 0 THEN 'no' ELSE 'yes' END AS f,
                   CASE WHEN tag <> 'view' THEN CAST(trajectory % 5 AS DOUBLE) END AS b FROM fx_points) p GROUP BY ALL""",
    ),
)


def _marks(s, d):
    return V.points(s, d).where("tag = 'purchase'").select(*KEY, "frame")


register(
    "b16_invalidate_points",
    f"{K} frame:i spot_x:d intensity:d speed:d",
    lambda s, d: P.speeds(P.invalidate_points(V.points(s, d), _marks(s, d))),
    sql_with(
        "fx_points",
        """SELECT *, sqrt((spot_x - px) * (spot_x - px) + (spot_y - py) * (spot_y - py)) AS speed
           FROM (SELECT *, lag(spot_x) OVER w AS px, lag(spot_y) OVER w AS py FROM (
                   SELECT movie, trajectory, frame, CASE WHEN tag <> 'purchase' THEN spot_x END AS spot_x,
                     CASE WHEN tag <> 'purchase' THEN spot_y END AS spot_y,
                     CASE WHEN tag <> 'purchase' THEN intensity END AS intensity FROM fx_points) i
                 WINDOW w AS (PARTITION BY movie, trajectory ORDER BY frame)) s""",
    ),
)

register(
    "b18_needs_recompute",
    K,
    lambda s, d: P.needs_recompute(V.points(s, d).withColumn("frame", F.col("frame") - F.floor(F.col("frame") / 14) * (F.col("trajectory") % 2))),
    sql_with(
        "fx_points",
        """SELECT movie, trajectory
           FROM (SELECT movie, trajectory, frame - frame // 14 * (trajectory % 2) AS f FROM fx_points) p GROUP BY ALL
           HAVING count(DISTINCT f) <> max(f) - min(f) + 1 OR count(*) <> max(f) - min(f) + 1""",
    ),
)

register(
    "b19_column_profile",
    "movie:l spot_x:l intensity:l note:l",
    lambda s, d: P.column_profile(
        V.points(s, d).withColumn("note", F.when(F.col("tag") == "click", F.lit(" ")).when(F.col("tag") == "view", F.col("tag")))
    ),
    sql_with(
        "fx_points",
        """SELECT count(nullif(trim(movie), '')) AS movie, count(spot_x) AS spot_x, count(intensity) AS intensity,
             count(*) FILTER (WHERE tag = 'view') AS note FROM fx_points""",
    ),
)

register(
    "b20_to_number",
    "event_id:l n:d",
    lambda s, d: V.table(s, d, "events").select(
        "event_id",
        S.to_number(
            F.when(F.col("event_type") == "view", F.lit(""))
            .when(F.col("event_type") == "error", F.lit("NaN"))
            .when(F.col("event_type") == "click", F.col("props"))
            .otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(".25 ")))
        ).alias("n"),
    ),
    """SELECT event_id, CASE WHEN event_type NOT IN ('view', 'error', 'click') THEN event_id + 0.25 END AS n FROM events""",
)

register(
    "b11_classify_points_fit",
    f"{K} frame:i status:s",
    lambda s, d: P.classify_points(V.points(s, d)),
    sql_with(
        "fx_points",
        "SELECT *, CASE WHEN intensity IS NULL THEN 'unfitted' ELSE 'fitted' END AS status FROM fx_points",
    ),
)

register(
    "b11_classify_points_binary",
    f"{K} frame:i status:s",
    lambda s, d: P.classify_points(V.points(s, d).withColumn("mark", F.when(F.col("tag") == "click", " x ").when(F.col("tag") == "view", " ")), "binary"),
    sql_with("fx_points", "SELECT *, CASE WHEN tag = 'click' THEN 'marked' ELSE 'unmarked' END AS status FROM fx_points"),
)
register(
    "b11_classify_points_value",
    f"{K} frame:i status:s",
    lambda s, d: P.classify_points(V.points(s, d).withColumn("value", F.when(F.col("tag") == "view", "").otherwise(F.nullif("tag", F.lit("click")))), "value"),
    sql_with("fx_points", "SELECT *, CASE WHEN tag IN ('view', 'click') THEN 'none' ELSE tag END AS status FROM fx_points"),
)
register(
    "d21_trace_stats",
    f"{K} mean_intensity:d median_intensity:d",
    lambda s, d: P.trace_stats(V.points(s, d)),
    sql_with(
        "fx_points",
        "SELECT movie, trajectory, avg(intensity) AS mean_intensity, median(intensity) AS median_intensity FROM fx_points GROUP BY ALL",
    ),
)

register(
    "c13_realign",
    f"{K} frame:i spot_x:d",
    lambda s, d: P.realign(P.valid_points(V.points(s, d)).drop("channel"), V.points(s, d)),
    sql_with("fx_points", "SELECT movie, trajectory, frame, CASE WHEN intensity > 0 THEN spot_x END AS spot_x FROM fx_points"),
)

register(
    "a12_select_trajectories",
    f"{K} frame:i",
    lambda s, d: P.select_trajectories(V.points(s, d), V.points(s, d).where("tag = 'error' and frame < 2")),
    sql_with(
        "fx_points",
        """SELECT movie, trajectory, frame FROM fx_points
           WHERE trajectory IN (SELECT trajectory FROM fx_points WHERE tag = 'error' AND frame < 2)""",
    ),
)

register(
    "e11_spot_gaps",
    f"{K} kind:s f0:i x0:d y0:d f1:i x1:d y1:d",
    lambda s, d: P.spot_gaps(V.points(s, d)),
    sql_with(
        "fx_points",
        """SELECT movie, trajectory, 'gap' AS kind, pf AS f0, px AS x0, py AS y0, frame AS f1, spot_x AS x1, spot_y AS y1
           FROM (SELECT *, lag(idx) OVER w AS pi, lag(frame) OVER w AS pf, lag(spot_x) OVER w AS px, lag(spot_y) OVER w AS py
                 FROM idx WHERE spot_x IS NOT NULL WINDOW w AS (PARTITION BY trajectory ORDER BY frame)) g WHERE idx - pi > 1
           UNION ALL
           SELECT a.movie, a.trajectory, 'lead_in', a.frame, a.search_x, a.search_y, f.frame, f.spot_x, f.spot_y
           FROM idx a JOIN ends e USING (trajectory) JOIN idx f ON f.trajectory = a.trajectory AND f.frame = e.f0
           WHERE a.idx = 1 AND e.f0 > a.frame
           UNION ALL
           SELECT z.movie, z.trajectory, 'lead_out', f.frame, f.spot_x, f.spot_y, z.frame, z.search_x, z.search_y
           FROM idx z JOIN ends e USING (trajectory) JOIN idx f ON f.trajectory = z.trajectory AND f.frame = e.f1
           WHERE z.frame = e.last AND e.f1 < z.frame""",
        idx="SELECT *, row_number() OVER (PARTITION BY trajectory ORDER BY frame) AS idx FROM fx_points",
        ends="""SELECT trajectory, min(frame) FILTER (WHERE spot_x IS NOT NULL) AS f0,
                  max(frame) FILTER (WHERE spot_x IS NOT NULL) AS f1, max(frame) AS last FROM fx_points GROUP BY ALL""",
    ),
)

# Anchors and segments

SEGMENTS = """
SELECT movie, trajectory, k AS segment, CASE WHEN k = 1 THEN frame ELSE frame + 1 END AS start_frame,
  nf AS end_frame, frame AS anchor_frame, x AS x0, y AS y0, nx AS x1, ny AS y1
FROM (SELECT *, row_number() OVER w AS k, lead(frame) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny
      FROM fx_nodes WINDOW w AS (PARTITION BY movie, trajectory ORDER BY frame)) n
WHERE nf IS NOT NULL"""

LABELLED = """
SELECT p.*, CASE WHEN n.n IS NULL THEN NULL ELSE greatest(1, least(coalesce(b.before, 0) + 0, n.n - 1,
    coalesce(b.before, 0))) END AS segment
FROM fx_points p
LEFT JOIN (SELECT trajectory, count(*) AS n FROM fx_nodes GROUP BY ALL) n USING (trajectory)
LEFT JOIN (SELECT q.trajectory, q.frame, count(*) AS before FROM fx_points q JOIN fx_nodes a
           ON a.trajectory = q.trajectory AND a.frame < q.frame GROUP BY ALL) b
  ON b.trajectory = p.trajectory AND b.frame = p.frame"""

register(
    "e2_anchor_segments",
    f"{K} segment:i start_frame:i end_frame:i x0:d y0:d x1:d y1:d",
    lambda s, d: G.anchor_segments(V.nodes(s, d)),
    sql_with("fx_nodes", SEGMENTS),
)

register(
    "c8_label_segments",
    f"{K} frame:i segment:i",
    lambda s, d: G.label_segments(V.points(s, d), V.nodes(s, d)),
    sql_with("fx_nodes", LABELLED),
)

for _name, _compat, _t in (
    ("e3_densify", False, "(f - anchor_frame) * 1.0 / (end_frame - anchor_frame)"),
    ("e3_densify_lag_compat", True, "CASE WHEN end_frame > start_frame THEN (f - start_frame) * 1.0 / (end_frame - start_frame) ELSE 0 END"),
):
    register(
        _name,
        f"{K} segment:i frame:i x:d y:d",
        lambda s, d, c=_compat: G.densify(V.nodes(s, d), lag_compat=c),
        sql_with(
            "fx_nodes",
            f"""SELECT movie, trajectory, segment, f AS frame, x0 + {_t} * (x1 - x0) AS x, y0 + {_t} * (y1 - y0) AS y
                FROM (SELECT *, unnest(range(start_frame, end_frame + 1)) AS f FROM ({SEGMENTS}) s) r""",
        ),
    )

register(
    "e13_dedupe_nodes",
    f"{K} frame:i pos:l x:d",
    lambda s, d: G.dedupe_nodes(
        V.points(s, d).select(
            *KEY,
            F.floor(F.col("frame") / 4).alias("frame"),
            F.floor(F.col("search_x") / 64).alias("x"),
            F.col("frame").cast("long").alias("pos"),
        ),
        order="pos",
    ),
    sql_with(
        "fx_points",
        """SELECT movie, trajectory, f AS frame, pos, x
           FROM (SELECT *, lag(f) OVER w AS pf, lag(x) OVER w AS px
                 FROM (SELECT movie, trajectory, frame // 4 AS f, frame AS pos, floor(search_x / 64) AS x FROM fx_points) n
                 WINDOW w AS (PARTITION BY movie, trajectory ORDER BY pos)) q
           WHERE pf IS DISTINCT FROM f OR px IS DISTINCT FROM x""",
    ),
)
