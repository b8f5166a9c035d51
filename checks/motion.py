"""Diffusion, steps, smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.points import SEGMENTS, K
from checks.registry import register
from checks.views import sql_with
from trackloom.config import KEY
from trackloom.operators import diffusion as D
from trackloom.operators import points as P
from trackloom.operators import smoothing as E
from trackloom.operators import steps as T
from trackloom.operators.segments import in_segment_rows
from trackloom.plans.stages import stage


def msd_sql(source: str, group: str, lags: int, pairs: int) -> str:
    return f"""
SELECT {group}, lag, count(*) AS pairs, greatest(avg((b_x - a_x) ** 2 + (b_y - a_y) ** 2), 1e-12) AS msd, avg(b_f - a_f) AS dt
FROM (SELECT {', '.join('a.' + g.strip() for g in group.split(','))}, b.k - a.k AS lag, a.spot_x AS a_x, a.spot_y AS a_y, a.frame AS a_f,
        b.spot_x AS b_x, b.spot_y AS b_y, b.frame AS b_f
      FROM ({source}) a JOIN ({source}) b USING ({group}) WHERE b.k - a.k BETWEEN 1 AND {lags}) p
GROUP BY {group}, lag HAVING count(*) >= {pairs} AND count(*) + lag >= 3"""


def fit_sql(curve: str, group: str) -> str:
    return f"""
SELECT {group}, lags, alpha, exp(b) / 4 * (pixel_size_nm / 1000) ** 2 / (frame_interval_ms / 1000) ** alpha AS d_um2_s
FROM (SELECT {group}, count(*) AS lags, regr_slope(ln(msd), ln(dt)) AS alpha, regr_intercept(ln(msd), ln(dt)) AS b
      FROM ({curve}) c GROUP BY {group} HAVING count(*) >= 2) f
JOIN fx_movies USING (movie) WHERE pixel_size_nm IS NOT NULL"""


FITS = """SELECT movie, trajectory, frame, spot_x, spot_y, row_number() OVER (PARTITION BY trajectory ORDER BY frame) AS k
FROM fx_points WHERE spot_x IS NOT NULL"""
SEG_FITS = f"""SELECT p.movie, p.trajectory, s.segment, frame, spot_x, spot_y,
  row_number() OVER (PARTITION BY p.trajectory, s.segment ORDER BY frame) AS k
FROM fx_points p JOIN ({SEGMENTS}) s ON s.trajectory = p.trajectory AND p.frame BETWEEN s.start_frame AND s.end_frame
WHERE spot_x IS NOT NULL"""
G2, G3 = "movie, trajectory", "movie, trajectory, segment"

register(
    "d8_msd",
    f"{K} lag:i pairs:l msd:d dt:d",
    lambda s, d: D.msd(V.points(s, d)),
    sql_with("fx_points", msd_sql(FITS, G2, 10, 5)),
)
register(
    "d9_diffusion",
    f"{K} lags:l alpha:d d_um2_s:d",
    lambda s, d: D.diffusion(V.points(s, d), V.movies(s, d)),
    sql_with("fx_points fx_movies", fit_sql(msd_sql(FITS, G2, 10, 5), G2)),
)
register(
    "d10_diffusion_by_segment",
    f"{K} segment:i lags:l alpha:d d_um2_s:d",
    lambda s, d: D.diffusion_by_segment(V.points(s, d), V.nodes(s, d), V.movies(s, d), max_lag=4, min_pairs=2),
    sql_with("fx_nodes fx_movies", fit_sql(msd_sql(SEG_FITS, G3, 4, 2), G3)),
)


def _seg_fit(s, d):
    return D.diffusion_by_segment(V.points(s, d), V.nodes(s, d), V.movies(s, d), max_lag=4, min_pairs=2)


register(
    "c12_cached_first",
    f"{K} segment:i d_um2_s:d alpha:d",
    lambda s, d: D.cached_first(
        V.nodes(s, d).select(*KEY, F.lit(1).alias("segment"), F.lit(0.5).alias("d_um2_s"), F.lit(None).cast("double").alias("alpha")).distinct(),
        _seg_fit(s, d),
    ),
    sql_with(
        "fx_nodes fx_movies",
        f"""SELECT movie, trajectory, segment, coalesce(c.d, f.d_um2_s) AS d_um2_s, f.alpha
            FROM ({fit_sql(msd_sql(SEG_FITS, G3, 4, 2), G3)}) f
            FULL JOIN (SELECT DISTINCT movie, trajectory, 1 AS segment, 0.5 AS d FROM fx_nodes) c USING (movie, trajectory, segment)""",
    ),
)
register(
    "b11_classify_points_segment_d",
    f"{K} frame:i segment:i status:s",
    lambda s, d: P.classify_points(in_segment_rows(V.points(s, d), V.nodes(s, d)), "segment_d", _seg_fit(s, d)),
    sql_with(
        "fx_nodes fx_movies",
        f"""SELECT p.movie, p.trajectory, p.frame, s.segment, CASE WHEN v IS NULL THEN 'N/A' WHEN v < 0.01 THEN 'D < 0.01 μm²/s'
              WHEN v < 0.1 THEN '0.01–0.1 μm²/s' WHEN v < 1 THEN '0.1–1 μm²/s' ELSE 'D ≥ 1 μm²/s' END AS status
            FROM fx_points p JOIN ({SEGMENTS}) s ON s.trajectory = p.trajectory AND p.frame BETWEEN s.start_frame AND s.end_frame
            LEFT JOIN (SELECT trajectory, segment, d_um2_s AS v FROM ({fit_sql(msd_sql(SEG_FITS, G3, 4, 2), G3)}) q) f
              ON f.trajectory = p.trajectory AND f.segment = s.segment""",
    ),
)
register(
    "b11_classify_points_segment_alpha",
    f"{K} frame:i segment:i status:s",
    lambda s, d: P.classify_points(
        in_segment_rows(V.points(s, d), V.nodes(s, d)), "segment_alpha", _seg_fit(s, d)
    ),
    sql_with(
        "fx_nodes fx_movies",
        f"""SELECT p.movie, p.trajectory, p.frame, s.segment, CASE WHEN a IS NULL THEN 'N/A' WHEN a < 0.5 THEN 'α < 0.5  (confined)'
              WHEN a < 0.9 THEN '0.5–0.9  (subdiff.)' WHEN a < 1.1 THEN '0.9–1.1  (Brownian)'
              WHEN a < 1.5 THEN '1.1–1.5  (superdiff.)' ELSE 'α ≥ 1.5  (directed)' END AS status
            FROM fx_points p JOIN ({SEGMENTS}) s ON s.trajectory = p.trajectory AND p.frame BETWEEN s.start_frame AND s.end_frame
            LEFT JOIN (SELECT trajectory, segment, alpha AS a FROM ({fit_sql(msd_sql(SEG_FITS, G3, 4, 2), G3)}) q) f
              ON f.trajectory = p.trajectory AND f.segment = s.segment""",
    ),
)

# Steps: half window 3, two passes

HALF, STEP = 3, 20.0


def sides(src: str, col: str, half: int) -> str:
    """SQL: windows ahead and behind, the end value repeated beyond both ends."""
    return f"""
SELECT *, list_concat(fw, list_transform(range(0, {half} + 1 - len(fw)), lambda z: xn)) AS a,
  list_concat(list_transform(range(0, {half} + 1 - len(bw)), lambda z: x1), bw) AS b
FROM (SELECT *, list({col}) OVER (w ROWS BETWEEN CURRENT ROW AND {half} FOLLOWING) AS fw,
        list({col}) OVER (w ROWS BETWEEN {half} PRECEDING AND CURRENT ROW) AS bw,
        first_value({col}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x1,
        last_value({col}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS xn
      FROM ({src}) s WINDOW w AS (PARTITION BY trajectory ORDER BY frame)) f"""


def one_pass(src: str, half: int) -> str:
    return f"""
SELECT movie, trajectory, frame, CASE WHEN va = 0 AND vb = 0 THEN (ma + mb) / 2 WHEN vb = 0 THEN mb WHEN va = 0 THEN ma
  ELSE ma / (1 + (va / vb) ** 10) + mb / (1 + (vb / va) ** 10) END AS x
FROM (SELECT *, list_avg(a) AS ma, list_avg(b) AS mb, list_var_pop(a) AS va, list_var_pop(b) AS vb FROM ({sides(src, 'x', half)}) q) v"""


def smooth_sql(half: int, passes: int) -> str:
    x = "SELECT movie, trajectory, frame, intensity AS x FROM fx_points WHERE intensity IS NOT NULL"
    for _ in range(passes):
        x = one_pass(x, half)
    return f"""
SELECT movie, trajectory, frame, round(x, 9) AS smooth, round(list_avg(a) - list_avg(b), 9) AS slope
FROM ({sides(x, 'x', half)}) z"""


def edges_sql(smooth: str, min_step: float) -> str:
    return f"""
SELECT *, n IS NULL OR p IS NULL AS is_end,
  p IS NOT NULL AND abs(slope) > {min_step} AND CASE WHEN n IS NULL THEN slope <> p ELSE sign(n - slope) <> sign(slope - p) END AS is_edge
FROM (SELECT *, lag(slope) OVER w AS p, lead(slope) OVER w AS n FROM ({smooth}) s
      WINDOW w AS (PARTITION BY trajectory ORDER BY frame)) e"""


SMOOTH = smooth_sql(HALF, 2)
EDGES = edges_sql(SMOOTH, STEP)
STEPS = """
SELECT c.movie, c.trajectory, c.step, c.frame AS start_frame, c.nf AS end_frame, median(s.smooth) AS level
FROM (SELECT *, row_number() OVER w - 1 AS step, lead(frame) OVER w AS nf FROM edges WHERE is_end OR is_edge
      WINDOW w AS (PARTITION BY trajectory ORDER BY frame)) c
JOIN edges s ON s.trajectory = c.trajectory AND s.frame BETWEEN c.frame AND c.nf
WHERE c.nf IS NOT NULL GROUP BY ALL"""

KW = {"half": HALF, "passes": 2}


def _smoothed(s, d, **options):
    """Stored once; rounded so that equal slopes are equal in both engines."""
    e = T.edge_smooth(V.points(s, d), **(options or KW))
    return stage(e.withColumn("smooth", F.round("smooth", 9)).withColumn("slope", F.round("slope", 9)), "smoothed")


def _steps(s, d):
    return T.steps(_smoothed(s, d), STEP)


register(
    "e4_edge_smooth",
    f"{K} frame:i smooth:d slope:d",
    lambda s, d: T.edge_smooth(V.points(s, d), **KW),
    sql_with("fx_points", SMOOTH),
)
register(
    "e5_step_edges",
    f"{K} frame:i slope:d",
    lambda s, d: T.step_edges(_smoothed(s, d), STEP),
    sql_with("fx_points", "SELECT * FROM edges WHERE is_edge", edges=EDGES),
)
register(
    "e6_steps",
    f"{K} step:i start_frame:i end_frame:i level:d",
    _steps,
    sql_with("fx_points", STEPS, edges=EDGES),
)
register(
    "e6_steps_ten_passes",
    f"{K} step:i start_frame:i end_frame:i level:d",
    lambda s, d: T.steps(_smoothed(s, d, half=15, passes=10)),
    sql_with("fx_points", STEPS, edges=edges_sql(smooth_sql(15, 10), 100.0)),
)


def _backgrounds(s, d):
    return V.points(s, d).select(*KEY, F.when(F.col("trajectory") % 2 == 0, F.lit(7.0)).alias("fixed_background")).distinct()


register(
    "d7_step_summary",
    f"{K} n_steps:l mean_step:d mean_step_background:d",
    lambda s, d: T.step_summary(_steps(s, d), _backgrounds(s, d)),
    sql_with(
        "fx_points",
        f"""SELECT movie, trajectory, count(*) AS n_steps, avg(abs(level - p)) AS mean_step,
              CASE WHEN count(*) = 1 THEN NULL WHEN any_value(trajectory) % 2 = 0
                THEN (sum(abs(level - p)) + abs(arg_max(level, step) - 7)) / count(*) ELSE avg(abs(level - p)) END AS mean_step_background
            FROM (SELECT *, lag(level) OVER (PARTITION BY trajectory ORDER BY step) AS p FROM ({STEPS}) s) q
            GROUP BY ALL""",
        edges=EDGES,
    ),
)

LABELS = f"""
SELECT p.movie, p.trajectory, p.frame, min(s.step) AS step, arg_min(s.level, s.step) AS level
FROM fx_points p LEFT JOIN ({STEPS}) s ON s.trajectory = p.trajectory AND p.frame BETWEEN s.start_frame AND s.end_frame
GROUP BY ALL"""
register(
    "c7_label_steps",
    f"{K} frame:i step:i level:d",
    lambda s, d: T.label_steps(V.points(s, d), _steps(s, d)),
    sql_with("fx_points", LABELS, edges=EDGES),
)
register(
    "d20_steps_from_points",
    f"{K} step:i start_frame:i end_frame:i level:d",
    lambda s, d: T.steps_from_points(T.label_steps(V.points(s, d), _steps(s, d))),
    sql_with(
        "fx_points",
        f"""SELECT movie, trajectory, step, min(frame) AS start_frame, max(frame) AS end_frame, any_value(level) AS level
            FROM ({LABELS}) l WHERE step IS NOT NULL GROUP BY ALL""",
        edges=EDGES,
    ),
)

# Smoothing of the path

FILLED = """
SELECT *, CASE WHEN spot_x IS NOT NULL THEN spot_x ELSE coalesce(px + (pos - pp) * 1.0 / (np - pp) * (nx - px), px, nx) END AS fill_x,
  CASE WHEN spot_x IS NOT NULL THEN spot_y ELSE coalesce(py + (pos - pp) * 1.0 / (np - pp) * (ny - py), py, ny) END AS fill_y
FROM (SELECT *, last_value(CASE WHEN spot_x IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
        last_value(spot_x IGNORE NULLS) OVER b AS px, last_value(spot_y IGNORE NULLS) OVER b AS py,
        first_value(CASE WHEN spot_x IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS np,
        first_value(spot_x IGNORE NULLS) OVER a AS nx, first_value(spot_y IGNORE NULLS) OVER a AS ny
      FROM (SELECT *, row_number() OVER (PARTITION BY trajectory ORDER BY frame) - 1 AS pos,
              count(*) OVER (PARTITION BY trajectory) AS n FROM fx_points) i
      WINDOW b AS (PARTITION BY trajectory ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             a AS (PARTITION BY trajectory ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) f"""
register(
    "e7_interpolate_gaps",
    f"{K} frame:i pos:l fill_x:d fill_y:d",
    lambda s, d: E.interpolate_gaps(V.points(s, d)),
    sql_with("fx_points", FILLED),
)
_QUAD = """(s4 * t0 - s2 * t2) / (s0 * s4 - s2 * s2) + t1 / s2 * o + (s0 * t2 - s2 * t0) / (s0 * s4 - s2 * s2) * o * o"""
SAVGOL = f"""
SELECT *, {_QUAD.replace('t0', 'x0').replace('t1', 'x1').replace('t2', 'x2')} AS smooth_x,
  {_QUAD.replace('t0', 'y0').replace('t1', 'y1').replace('t2', 'y2')} AS smooth_y
FROM (SELECT r.movie, r.trajectory, r.frame, any_value(r.fill_x) AS fill_x, any_value(r.fill_y) AS fill_y, any_value(o) AS o,
        count(*) AS s0, sum(j * j) AS s2, sum(j * j * j * j) AS s4, sum(q.fill_x) AS x0, sum(j * q.fill_x) AS x1,
        sum(j * j * q.fill_x) AS x2, sum(q.fill_y) AS y0, sum(j * q.fill_y) AS y1, sum(j * j * q.fill_y) AS y2
      FROM (SELECT *, greatest(m, least(pos, n - 1 - m)) AS c, pos - greatest(m, least(pos, n - 1 - m)) AS o
            FROM (SELECT *, least(5, (n - 1) // 2) AS m FROM filled) i) r
      JOIN filled q ON q.trajectory = r.trajectory AND q.pos BETWEEN r.c - r.m AND r.c + r.m, LATERAL (SELECT q.pos - r.c AS j) l
      GROUP BY r.movie, r.trajectory, r.frame) z"""
register(
    "e8_savgol",
    f"{K} frame:i smooth_x:d smooth_y:d",
    lambda s, d: E.savgol(E.interpolate_gaps(V.points(s, d))),
    sql_with("fx_points", SAVGOL, filled=FILLED),
)
register(
    "e9_smooth_outliers",
    f"{K} frame:i deviation:d outlier:b",
    lambda s, d: E.smooth_outliers(V.points(s, d)),
    sql_with(
        "fx_points",
        """SELECT movie, trajectory, frame, dev AS deviation, dev > least(3, 2 * sg) AS outlier
           FROM (SELECT g.*, sqrt((fill_x - smooth_x) ** 2 + (fill_y - smooth_y) ** 2) AS dev, sg
                 FROM sav g JOIN (SELECT trajectory, avg(sigma) AS sg FROM fx_points GROUP BY ALL) s USING (trajectory)) d""",
        filled=FILLED,
        sav=SAVGOL,
    ),
)
