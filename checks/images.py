"""Pixel-table queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import register
from checks.views import sql_with
from trackloom.config import Params
from trackloom.operators import measure as S
from trackloom.operators import pixels as X
from trackloom.operators import rois as R
from trackloom.plans.stages import shared_folder
from trackloom.sources.tables import read_pixels, write_pixels

PX = "movie:s channel:i frame:i y:i x:i v:d"
WK = "movie:s channel:i frame:i trajectory:l"
R6 = 6
CROP = f"""
SELECT w.*, p.y, p.x, p.v FROM fx_windows w JOIN fx_pixels p
  ON p.movie = w.movie AND p.channel = w.channel AND p.frame = w.frame
  AND p.x >= round_even(search_x, 0) - {R6} AND p.x < round_even(search_x, 0) + {R6}
  AND p.y >= round_even(search_y, 0) - {R6} AND p.y < round_even(search_y, 0) + {R6}"""


def _stored_pixels(s, d):
    """The pixels written by movie and channel, as the reader expects them."""
    path = f"{shared_folder(s)}/trackloom/pixels-{uuid.uuid4().hex}"
    write_pixels(V.pixels(s, d), path)
    return path


register(
    "a1_read_pixels",
    PX,
    lambda s, d: read_pixels(s, _stored_pixels(s, d), channel=1, frames=(1, 4)),
    sql_with("fx_pixels", "SELECT * FROM fx_pixels WHERE channel = 1 AND frame BETWEEN 1 AND 4"),
)
register(
    "a2_explode_frames",
    "vec_id:l y:i x:i v:d",
    lambda s, d: X.explode_frames(V.table(s, d, "embeddings").select("vec_id", "embedding"), "embedding", 8),
    """SELECT vec_id, pos // 8 AS y, pos % 8 AS x, v FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, 64)) AS pos FROM embeddings) e""",
)
register(
    "c6_search_crops",
    f"{WK} y:i x:i v:d",
    lambda s, d: X.search_crops(V.windows(s, d), V.pixels(s, d), R6),
    sql_with("fx_windows fx_pixels", CROP),
)
register(
    "d22_snr_gate",
    f"{WK} max_v:d median_v:d std_v:d passes:b",
    lambda s, d: X.snr_gate(X.search_crops(V.windows(s, d), V.pixels(s, d), R6)),
    sql_with(
        "fx_windows fx_pixels",
        f"""SELECT movie, channel, frame, trajectory, max(v) AS max_v, median(v) AS median_v, stddev_pop(v) AS std_v,
              max(v) - median(v) >= 4 * stddev_pop(v) AS passes FROM ({CROP}) c GROUP BY ALL""",
    ),
)
register(
    "d24_lower_half_background",
    f"{WK} background:d",
    lambda s, d: X.lower_half_background(X.search_crops(V.windows(s, d), V.pixels(s, d), R6)),
    sql_with(
        "fx_windows fx_pixels",
        f"""SELECT movie, channel, frame, trajectory, coalesce(median(v) FILTER (WHERE v < cut), min(v)) AS background
            FROM (SELECT *, min(v) OVER w + 0.5 * (max(v) OVER w - min(v) OVER w) AS cut FROM ({CROP}) c
                  WINDOW w AS (PARTITION BY movie, channel, frame, trajectory)) d GROUP BY ALL""",
    ),
)
register(
    "d11_trajectory_background",
    "movie:s trajectory:l trajectory_background:d",
    lambda s, d: X.trajectory_background(V.windows(s, d), V.pixels(s, d), V.pixel_movies(s, d), R6, 0.3),
    sql_with(
        "fx_windows fx_pixels",
        f"""SELECT movie, trajectory, median(v) AS trajectory_background FROM (
              SELECT *, unnest([y0 >= 0 AND y < ya + b, y1 <= 20 AND y >= yb - b, x0 >= 0 AND x < xa + b, x1 <= 64 AND x >= xb - b]) AS hit
              FROM (SELECT *, greatest(1, CAST(floor(least(yb - ya, xb - xa) * 0.3) AS INT)) AS b
                    FROM (SELECT *, greatest(x0, 0) AS xa, least(x1, 64) AS xb, greatest(y0, 0) AS ya, least(y1, 20) AS yb
                          FROM (SELECT *, round_even(search_x, 0) - {R6} AS x0, round_even(search_x, 0) + {R6} AS x1,
                                  round_even(search_y, 0) - {R6} AS y0, round_even(search_y, 0) + {R6} AS y1 FROM ({CROP}) c) d) e) f) g
            WHERE hit GROUP BY ALL""",
    ),
)
register(
    "d12_max_projection",
    "movie:s channel:i y:i x:i v:d",
    lambda s, d: X.max_projection(V.pixels(s, d), V.pixel_movies(s, d)),
    sql_with("fx_pixels", "SELECT movie, channel, y, x, max(v) AS v FROM fx_pixels GROUP BY ALL"),
)


def limits_sql(group: str, a: float, z: float, fa: float, fz: float) -> str:
    return f"""SELECT *, vmin - CAST(trunc((vmax - vmin) * 0.7::DOUBLE) AS INT) AS ext_min, vmax + CAST(trunc((vmax - vmin) * 1.4::DOUBLE) AS INT) AS ext_max
      FROM (SELECT {group}, CAST(trunc(quantile_cont(v, {a}) * {fa}::DOUBLE) AS INT) AS vmin, CAST(trunc(quantile_cont(v, {z}) * {fz}::DOUBLE) AS INT) AS vmax
            FROM fx_pixels GROUP BY ALL) q"""


LIM = "vmin:i vmax:i ext_min:i ext_max:i"
register(
    "d13_contrast_limits",
    f"movie:s channel:i frame:i {LIM}",
    lambda s, d: X.contrast_limits(V.pixels(s, d)),
    sql_with("fx_pixels", limits_sql("movie, channel, frame", 0.15, 0.99, 1.0, 1.1)),
)
register(
    "d13_contrast_limits_movie",
    f"movie:s channel:i {LIM}",
    lambda s, d: X.contrast_limits(V.pixels(s, d), ("movie", "channel"), "projection"),
    sql_with("fx_pixels", limits_sql("movie, channel", 0.15, 0.99, 1.05, 1.2)),
)
def bins_sql(src: str) -> str:
    """SQL: ``src`` (columns v, lo, hi) with the number of its bin, of 50 that begin at lo + i * (hi - lo) / 50."""
    edge = "({i}) * ((hi - lo) / 50) + lo"
    return f"""SELECT *, CASE WHEN v < {edge.format(i='i')} THEN i - 1 WHEN i < 49 AND v >= {edge.format(i='i + 1')} THEN i + 1 ELSE i END AS bin
      FROM (SELECT *, least(floor((v - lo) * 50 / (hi - lo)), 49) AS i FROM ({src}) s) t"""


register(
    "d14_pixel_histogram",
    f"{WK} bin:i pixels:l core_pixels:l",
    lambda s, d: X.pixel_histogram(V.windows(s, d).withColumn("sigma", 1 + 0.25 * (F.col("trajectory") % 4)), V.pixels(s, d), R6),
    sql_with(
        "fx_windows fx_pixels",
        f"""SELECT movie, channel, frame, trajectory, bin, count(*) AS pixels,
              count(*) FILTER (WHERE sqrt((x - round_even(search_x, 0)) ** 2 + (y - round_even(search_y, 0)) ** 2)
                <= 2 * (1 + 0.25 * (trajectory % 4))) AS core_pixels
            FROM ({bins_sql(f"""SELECT *, min(v) OVER w - CASE WHEN min(v) OVER w = max(v) OVER w THEN 0.5 ELSE 0 END AS lo,
                    max(v) OVER w + CASE WHEN min(v) OVER w = max(v) OVER w THEN 0.5 ELSE 0 END AS hi FROM ({CROP}) c
                  WINDOW w AS (PARTITION BY movie, channel, frame, trajectory)""")}) d GROUP BY ALL""",
    ),
)



def image_sql(frames: str) -> str:
    """SQL: the histogram of whole images, of the columns movie, channel, frame and v."""
    ranged = f"""SELECT *, min(v) OVER w - CASE WHEN min(v) OVER w = max(v) OVER w THEN 0.5 ELSE 0 END AS lo,
        max(v) OVER w + CASE WHEN min(v) OVER w = max(v) OVER w THEN 0.5 ELSE 0 END AS hi FROM ({frames}) f
      WINDOW w AS (PARTITION BY movie, channel, frame)"""
    return f"SELECT movie, channel, frame, bin, count(*) AS pixels FROM ({bins_sql(ranged)}) d GROUP BY ALL"


register(
    "d14_image_histogram",
    "movie:s channel:i frame:i bin:i pixels:l",
    lambda s, d: X.image_histogram(V.pixels(s, d)),
    sql_with("fx_pixels", image_sql("SELECT * FROM fx_pixels")),
)

def _some_without_centre(s, d):
    w = V.windows(s, d).withColumn("sigma", 1 + 0.25 * (F.col("trajectory") % 4))
    return w.withColumn("search_x", F.when(F.col("trajectory") != 3, F.col("search_x")))


register(
    "d14_histograms",
    f"{WK} bin:i pixels:l core_pixels:l",
    lambda s, d: X.histograms(_some_without_centre(s, d), V.pixels(s, d), R6),
    sql_with(
        "fx_windows fx_pixels",
        f"""SELECT movie, channel, frame, trajectory, bin, count(*) AS pixels,
              CASE WHEN any_value(trajectory) <> 3 THEN count(*) FILTER (WHERE sqrt((x - round_even(search_x, 0)) ** 2 + (y - round_even(search_y, 0)) ** 2)
                <= 2 * (1 + 0.25 * (trajectory % 4))) END AS core_pixels
            FROM ({bins_sql(f"""SELECT *, min(v) OVER w - CASE WHEN min(v) OVER w = max(v) OVER w THEN 0.5 ELSE 0 END AS lo,
                    max(v) OVER w + CASE WHEN min(v) OVER w = max(v) OVER w THEN 0.5 ELSE 0 END AS hi
                  FROM (SELECT * FROM ({CROP}) c WHERE trajectory <> 3 UNION ALL SELECT w.*, p.y, p.x, p.v FROM fx_windows w
                        JOIN fx_pixels p USING (movie, channel, frame) WHERE w.trajectory = 3) u
                  WINDOW w AS (PARTITION BY movie, channel, frame, trajectory)""")}) d GROUP BY ALL""",
    ),
)
register(
    "d12_short_movie_projection",
    "movie:s channel:i y:i x:i v:d",
    # Every four frames of a channel are a movie of one channel: those give their first frame.
    lambda s, d: X.max_projection(
        V.pixels(s, d)
        .withColumn("movie", F.concat_ws("-", "movie", "channel", F.floor(F.col("frame") / 4)))
        .withColumn("frame", F.col("frame") % 4),
        V.pixels(s, d)
        .select(F.concat_ws("-", "movie", "channel", F.floor(F.col("frame") / 4)).alias("movie"))
        .distinct()
        .withColumns({"n_channels": F.lit(1), "n_frames": F.lit(4)}),
    ),
    sql_with(
        "fx_pixels",
        "SELECT concat_ws('-', movie, channel, frame // 4) AS movie, channel, y, x, v FROM fx_pixels WHERE frame % 4 = 0",
    ),
)

# Kymographs

VERT = """SELECT movie, roi, k AS i, x[k + 1] AS x, y[k + 1] AS y FROM (SELECT *, unnest([0, 1, 2]) AS k FROM fx_pixel_rois) v"""
SEGS = f"""SELECT roi, i, x0, y0, x1, y1, len, coalesce(sum(len) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum,
    sum(len) OVER (PARTITION BY roi) AS total
  FROM (SELECT a.roi, a.i, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS len
        FROM ({VERT}) a JOIN ({VERT}) b ON a.roi = b.roi AND b.i = a.i + 1) s"""
ALONG = """SELECT movie, roi, s, n, px, py FROM (
    SELECT r.movie, r.roi, r.s, r.n, g.x0 + u * (g.x1 - g.x0) AS px, g.y0 + u * (g.y1 - g.y0) AS py,
      row_number() OVER (PARTITION BY r.roi, r.s ORDER BY CASE WHEN d < g.cum + g.len THEN g.i ELSE 10 - g.i END) AS pick
    FROM (SELECT *, unnest(range(0, n)) AS s FROM (
            SELECT r.movie, r.roi, total, CAST(greatest(floor(total), 2) AS INT) AS n
            FROM fx_pixel_rois r JOIN (SELECT roi, max(total) AS total FROM segs GROUP BY ALL) l USING (roi)) q) r
    JOIN segs g ON g.roi = r.roi,
    LATERAL (SELECT r.s * r.total / (r.n - 1) AS d) e,
    LATERAL (SELECT CASE WHEN g.len > 0 THEN greatest(0, least(1, (d - g.cum) / g.len)) ELSE 0 END AS u) f) p WHERE pick = 1"""
PLACES = """SELECT movie, roi, s, o, px + o * CASE WHEN nrm > 0 THEN -ty / nrm ELSE 0 END AS sx, py + o * CASE WHEN nrm > 0 THEN tx / nrm ELSE 0 END AS sy
  FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS o, sqrt(tx * tx + ty * ty) AS nrm
        FROM (SELECT c.*, b.px - a.px AS tx, b.py - a.py AS ty FROM along c
              JOIN along a ON a.roi = c.roi AND a.s = greatest(c.s - 1, 0)
              JOIN along b ON b.roi = c.roi AND b.s = least(c.s + 1, c.n - 1)) t) z"""


def mirrored(e: str, n: int) -> str:
    return f"CASE WHEN {e} < 0 THEN -1 - ({e}) WHEN {e} >= {n} THEN {2 * n - 1} - ({e}) ELSE {e} END"


KYMO = f"""SELECT k.movie, k.roi, k.s, k.o, p.channel, p.frame, sum(k.w * p.v) AS v
  FROM (SELECT movie, roi, s, o, {mirrored('floor(sx) + i', 64)} AS x, {mirrored('floor(sy) + j', 20)} AS y,
          (CASE i WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE j WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS w
        FROM places, (SELECT 0 AS i UNION ALL SELECT 1) ii, (SELECT 0 AS j UNION ALL SELECT 1) jj) k
  JOIN fx_pixels p ON p.movie = k.movie AND p.x = k.x AND p.y = k.y WHERE k.w > 0 GROUP BY ALL"""
KYMO_CTES = {"segs": SEGS, "along": ALONG, "places": PLACES}
KK = "movie:s roi:l channel:i frame:i s:i v:d"

for _name, _method, _agg in (("i1_kymograph", "max", "max(v)"), ("i1_kymograph_average", "average", "sum(v) / 5")):
    register(
        _name,
        KK,
        lambda s, d, m=_method: X.kymograph(V.pixels(s, d), V.pixel_rois(s, d), V.pixel_movies(s, d), method=m),
        sql_with(
            "fx_pixel_rois fx_pixels",
            f"SELECT movie, roi, channel, frame, s, {_agg} AS v FROM ({KYMO}) o GROUP BY movie, roi, channel, frame, s",
            **KYMO_CTES,
        ),
    )


def _sizes(s, d):
    return R.roi_table(V.pixel_rois(s, d)).join(V.pixel_movies(s, d).select("movie", "n_frames"), "movie")


def _kymo(s, d):
    return X.kymograph(V.pixels(s, d), V.pixel_rois(s, d), V.pixel_movies(s, d))


G0, G2 = X._kernels(1.5)


def taps(p: str, n: str) -> str:
    return f"CASE WHEN ({p}) % (2 * {n}) < {n} THEN ({p}) % (2 * {n}) ELSE 2 * {n} - 1 - ({p}) % (2 * {n}) END"


_PLUS = 12  # whole periods added before the remainder, so that it is not negative
register(
    "i2_log_filter",
    "movie:s roi:l channel:i frame:i s:i v:i",
    lambda s, d: X.log_filter(_kymo(s, d), _sizes(s, d)),
    sql_with(
        "fx_pixel_rois fx_pixels",
        f"""SELECT movie, roi, channel, frame, s,
              CASE WHEN hi > lo THEN CAST(floor(round((l - lo) / (hi - lo) * 254 + 1, 9)) AS INT) ELSE 128 END AS v
            FROM (SELECT *, min(l) OVER w AS lo, max(l) OVER w AS hi FROM lapl WINDOW w AS (PARTITION BY roi, channel)) z""",
        **KYMO_CTES,
        kymo=f"""SELECT k.*, n, f.nf FROM (SELECT movie, roi, channel, frame, s, max(v) AS v FROM ({KYMO}) o GROUP BY movie, roi, channel, frame, s) k
                 JOIN (SELECT DISTINCT roi, n FROM along) a USING (roi)
                 JOIN (SELECT movie, max(frame) + 1 AS nf FROM fx_pixels GROUP BY ALL) f USING (movie)""",
        kern=" UNION ALL ".join(f"SELECT {j} AS j, {G0[abs(j)]!r}::DOUBLE AS g0, {G2[abs(j)]!r}::DOUBLE AS g2" for j in range(-6, 7)),
        across=f"""SELECT t.movie, t.roi, t.channel, t.frame, t.s, t.nf, sum(g0 * q.v) AS a0, sum(g2 * q.v) AS a2
                   FROM kymo t, kern, kymo q WHERE q.roi = t.roi AND q.channel = t.channel AND q.frame = t.frame
                     AND q.s = {taps('t.s + j + 2 * t.n * ' + str(_PLUS), 't.n')} GROUP BY ALL""",
        lapl=f"""SELECT t.movie, t.roi, t.channel, t.frame, t.s, -sum(g2 * q.a0 + g0 * q.a2) AS l
                 FROM across t, kern, across q WHERE q.roi = t.roi AND q.channel = t.channel AND q.s = t.s
                   AND q.frame = {taps('t.frame + j + 2 * t.nf * ' + str(_PLUS), 't.nf')} GROUP BY ALL""",
    ),
)
register(
    "h4_invert_kymograph",
    KK,
    lambda s, d: R.invert_kymograph(_kymo(s, d), V.pixel_rois(s, d).where("movie = 'm1'"), _sizes(s, d)),
    sql_with(
        "fx_pixel_rois fx_pixels",
        f"""SELECT k.movie, k.roi, channel, frame, CASE WHEN k.movie = 'm1' THEN n - 1 - s ELSE s END AS s, v
            FROM (SELECT movie, roi, channel, frame, s, max(v) AS v FROM ({KYMO}) o GROUP BY movie, roi, channel, frame, s) k
            JOIN (SELECT DISTINCT roi, n FROM along) a USING (roi)""",
        **KYMO_CTES,
    ),
)

# Moves

GRID = "SELECT movie, channel, frame, y, x FROM fx_pixels"
register(
    "i11_translate",
    PX,
    lambda s, d: X.translate(V.pixels(s, d), V.pixel_movies(s, d), 3, -2),
    sql_with(
        "fx_pixels",
        f"SELECT g.*, coalesce(p.v, 0) AS v FROM ({GRID}) g LEFT JOIN (SELECT movie, channel, frame, y - 2 AS y, x + 3 AS x, v FROM fx_pixels) p USING (movie, channel, frame, y, x)",
    ),
)


def _offsets(s, d):
    return V.pixels(s, d).select("movie", "frame").distinct().select(
        "movie", "frame", (F.col("frame") * 0.3).alias("dx"), (F.col("frame") * -0.45).alias("dy")
    )


register(
    "i10_apply_drift",
    PX,
    lambda s, d: X.apply_drift(V.pixels(s, d), V.pixel_movies(s, d), _offsets(s, d)),
    sql_with(
        "fx_pixels",
        """SELECT g.movie, g.channel, g.frame, g.y, g.x, coalesce(p.v, 0) AS v
           FROM (SELECT *, x + frame * 0.3::DOUBLE AS qx, y + frame * -0.45::DOUBLE AS qy FROM fx_pixels) g
           LEFT JOIN fx_pixels p ON p.movie = g.movie AND p.channel = g.channel AND p.frame = g.frame
             AND p.x = g.x + floor(g.frame * 0.3::DOUBLE + 0.5) AND p.y = g.y + floor(g.frame * -0.45::DOUBLE + 0.5)
             AND qx BETWEEN 0 AND 63 AND qy BETWEEN 0 AND 19""",
    ),
)

# Spot measurement: crop 12, weak gates so that many windows pass

SOFT = Params(search_radius=R6, snr=2.0)
MEAS = "search_x:d search_y:d spot_x:d spot_y:d sigma:d peak:d background:d intensity:d"


def measure_sql(windows: str, snr: float, crop_column: bool = False) -> str:
    """SQL: the two passes over ``windows`` (window columns, search_x, search_y) with crop 12, or that of the row."""
    idc = "movie, channel, frame, trajectory" + (", crop" if crop_column else "")
    side = "crop" if crop_column else "12"

    def one(src: str) -> str:
        return f"""
SELECT *, sqrt(greatest(sxx / s - mx * mx, 0)) AS gx, sqrt(greatest(syy / s - my * my, 0)) AS gy,
  greatest(cx - 4, least(cx + 4, mx)) AS nx, greatest(cy - 4, least(cy + 4, my)) AS ny
FROM (SELECT *, sx / s AS mx, sy / s AS my FROM (
  SELECT {idc}, search_x, search_y, cx, cy, x0, y0, ok, bg, any_value(top) AS top, any_value(sd) AS sd,
    nullif(sum(greatest(v - bg, 0)), 0) AS s, sum(greatest(v - bg, 0) * x) AS sx, sum(greatest(v - bg, 0) * y) AS sy,
    sum(greatest(v - bg, 0) * x * x) AS sxx, sum(greatest(v - bg, 0) * y * y) AS syy
  FROM (SELECT c.*, b.bg, max(v) OVER w AS top, stddev_pop(v) OVER w AS sd FROM ({src}) c
        JOIN (SELECT {idc}, median(v) AS bg FROM (
                SELECT *, unnest([y < y0 + b, y >= y1 - b, x < x0 + b, x >= x1 - b]) AS hit
                FROM (SELECT *, greatest(1, CAST(floor(least(y1 - y0, x1 - x0) * 0.25) AS INT)) AS b FROM ({src}) c) e) f
              WHERE hit GROUP BY ALL) b USING ({idc})
        WINDOW w AS (PARTITION BY {idc})) g
  GROUP BY {idc}, search_x, search_y, cx, cy, x0, y0, ok, bg) h) i"""

    def crop(src: str) -> str:
        return f"""
SELECT w.*, p.x, p.y, p.v FROM (
  SELECT *, greatest(round_even(cx, 0) - {side} // 2, 0) AS x0, least(greatest(round_even(cx, 0) - {side} // 2, 0) + {side}, 64) AS x1,
    greatest(round_even(cy, 0) - {side} // 2, 0) AS y0, least(greatest(round_even(cy, 0) - {side} // 2, 0) + {side}, 20) AS y1 FROM ({src}) z) w
JOIN fx_pixels p ON p.movie = w.movie AND p.channel = w.channel AND p.frame = w.frame
  AND p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1"""

    def judged(src: str) -> str:
        return f"""SELECT *, ok AND top - bg >= {snr} * sd AND nx - x0 > 4 AND nx - x0 < {side} - 4 AND ny - y0 > 4 AND ny - y0 < {side} - 4 AS ok2 FROM ({src}) j"""

    start = f"""SELECT {idc}, search_x, search_y, search_x AS cx, search_y AS cy, ok FROM ({windows}) a
      JOIN (SELECT {idc}, max(v) - median(v) >= {snr} * stddev_pop(v) AS ok FROM (
              SELECT a.*, p.v FROM ({windows}) a JOIN fx_pixels p ON p.movie = a.movie AND p.channel = a.channel AND p.frame = a.frame
                AND p.x >= round_even(search_x, 0) - {side} // 2 AND p.x < round_even(search_x, 0) + {side} // 2
                AND p.y >= round_even(search_y, 0) - {side} // 2 AND p.y < round_even(search_y, 0) + {side} // 2) k GROUP BY ALL) g USING ({idc})"""
    first = judged(one(crop(start)))
    again = f"SELECT {idc}, search_x, search_y, nx AS cx, ny AS cy, ok2 AS ok FROM first1 WHERE ok2"
    last = judged(one(crop(again)))
    lo = repr(2 * (200 / 2.355) / 200.0)
    done = f"""SELECT *, greatest({lo}, least({side} / 4.0, gx)) AS hx, greatest({lo}, least({side} / 4.0, gy)) AS hy, top - bg AS a FROM ({last}) q"""
    return f"""WITH first1 AS ({first})
SELECT w.*, nx AS spot_x, ny AS spot_y, 0.5 * (hx + hy) AS sigma, a AS peak, CASE WHEN bg IS NOT NULL THEN greatest(bg, 0) END AS background, 2 * pi() * a * hx * hy AS intensity
FROM ({windows}) w LEFT JOIN (SELECT * FROM ({done}) d WHERE ok2 AND a >= 4) m USING ({idc}, search_x, search_y)"""


register(
    "i3_measure_spots",
    f"{WK} {MEAS}",
    lambda s, d: S.measure_spots(V.windows(s, d), V.pixels(s, d), V.pixel_movies(s, d), SOFT),
    sql_with("fx_windows fx_pixels", f"SELECT * FROM ({measure_sql('SELECT * FROM fx_windows', 2.0)}) m"),
)
