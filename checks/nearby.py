"""Same frame, nearby place."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.points import K
from checks.registry import register
from checks.views import sql_with
from trackloom.config import KEY
from trackloom.operators import points as P
from trackloom.operators import spots as N

CH = "CAST(1 + (trajectory // 3) % 3 AS INT)"


def _points3(s, d):
    """The points with three channels."""
    return V.points(s, d).withColumn("channel", (1 + F.floor(F.col("trajectory") / 3) % 3).cast("int"))


def _flags(s, d):
    p = _points3(s, d)
    return N.coloc_flags(p, p.where("spot_x is not null"), 3)


FLAGS = f"""
SELECT p.movie, p.trajectory, p.frame, p.channel, p.target,
  CASE WHEN p.spot_x IS NULL THEN NULL WHEN h.frame IS NULL THEN 'No' ELSE 'Yes' END AS flag
FROM (SELECT *, unnest([1, 2, 3]) AS target FROM p3) p
LEFT JOIN (SELECT DISTINCT a.trajectory, a.frame, b.channel AS target FROM p3 a JOIN p3 b
             ON a.movie = b.movie AND a.frame = b.frame AND a.channel <> b.channel
             AND (a.spot_x - b.spot_x) ** 2 + (a.spot_y - b.spot_y) ** 2 <= 16) h
  ON h.trajectory = p.trajectory AND h.frame = p.frame AND h.target = p.target
WHERE p.target <> p.channel"""
P3 = f"SELECT * EXCLUDE (channel), {CH} AS channel FROM fx_points"

register(
    "c3_avoid_previous",
    f"{K} frame:i spot_x:d intensity:d",
    lambda s, d: N.avoid_previous(V.points(s, d)),
    sql_with(
        "fx_points",
        """SELECT p.movie, p.trajectory, p.frame, CASE WHEN h.frame IS NULL THEN p.spot_x END AS spot_x,
             CASE WHEN h.frame IS NULL THEN p.intensity END AS intensity
           FROM fx_points p LEFT JOIN (SELECT DISTINCT a.trajectory, a.frame FROM fx_points a JOIN fx_points b
               ON a.movie = b.movie AND a.frame = b.frame AND b.trajectory < a.trajectory
               AND (a.spot_x - b.spot_x) ** 2 + (a.spot_y - b.spot_y) ** 2 < 36) h USING (trajectory, frame)""",
    ),
)


def _past(s, d):
    return P.valid_points(V.points(s, d)).select(
        "movie", F.concat_ws("-", "trajectory", "frame").alias("id"), "trajectory", "frame", F.col("spot_x").alias("x"), F.col("spot_y").alias("y")
    )


register(
    "c4_forget_centres",
    "movie:s id:s x:d",
    lambda s, d: N.forget_centres(_past(s, d), _past(s, d).where("trajectory % 5 = 0")),
    sql_with(
        "fx_points",
        """SELECT p.movie, concat(p.trajectory, '-', p.frame) AS id, p.spot_x AS x FROM fx_points p
           WHERE intensity > 0 AND NOT EXISTS (SELECT 1 FROM fx_points g WHERE g.trajectory % 5 = 0 AND g.intensity > 0
             AND g.movie = p.movie AND g.frame = p.frame AND (p.spot_x - g.spot_x) ** 2 + (p.spot_y - g.spot_y) ** 2 < 36)""",
    ),
)
register(
    "c5_colocalise",
    f"{K} frame:i channel:i target:i flag:s",
    _flags,
    sql_with("fx_points", FLAGS, p3=P3),
)
register(
    "c5_colocalise_any",
    f"{K} frame:i coloc:s",
    lambda s, d: N.coloc_any(_flags(s, d)),
    sql_with("fx_points", f"SELECT movie, trajectory, frame, max(flag) AS coloc FROM ({FLAGS}) f GROUP BY ALL", p3=P3),
)
register(
    "d6_coloc_percent",
    f"{K} ch1_pct:d ch2_pct:d ch3_pct:d",
    lambda s, d: N.coloc_percent(_flags(s, d), 3),
    sql_with(
        "fx_points",
        f"""SELECT movie, trajectory, {', '.join(f"round(100 * avg(CASE flag WHEN 'Yes' THEN 1.0 WHEN 'No' THEN 0.0 END) FILTER (WHERE target = {c}), 1) AS ch{c}_pct" for c in (1, 2, 3))}
            FROM ({FLAGS}) f GROUP BY ALL""",
        p3=P3,
    ),
)
register(
    "b11_classify_points_coloc",
    f"{K} frame:i status:s",
    lambda s, d: P.classify_points(N.coloc_any(_flags(s, d)), "coloc"),
    sql_with(
        "fx_points",
        f"""SELECT movie, trajectory, frame, CASE max(flag) WHEN 'Yes' THEN 'colocalised' WHEN 'No' THEN 'alone' ELSE 'none' END AS status
            FROM ({FLAGS}) f GROUP BY ALL""",
        p3=P3,
    ),
)
