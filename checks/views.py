"""Input tables for the registered queries, derived from the given tables.

Each view exists twice: as a DataFrame and as a SQL text for the oracle.  Every
view reads its whole table.  Frame gaps come from the frame numbering, so no
row is left out to make them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _trajectory():
    """128 trajectories of up to 64 points per 8,192 events."""
    return F.floor(F.col("event_id") / 8192) * 128 + F.col("event_id") % 128


def points(spark: SparkSession, d: str) -> DataFrame:
    """Events are points, 'error' events are failed fits; every 14th frame is missing."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    e = e.withColumn("t", _trajectory()).withColumn("f", F.floor(F.col("event_id") % 8192 / 128))
    ok = F.col("event_type") != "error"
    eid = F.col("event_id")
    x, y = (eid * 7 % 256).cast("double"), (eid * 13 % 256).cast("double")
    return e.select(
        F.concat(F.lit("m"), (F.col("t") % 3).cast("string")).alias("movie"),
        F.col("t").alias("trajectory"),
        (1 + F.floor(F.col("t") / 3) % 2).cast("int").alias("channel"),
        (F.col("f") + F.floor(F.col("f") / 13)).cast("int").alias("frame"),
        x.alias("search_x"),
        y.alias("search_y"),
        F.when(ok, x + 0.25 * (eid % 4)).alias("spot_x"),
        F.when(ok, y + 0.25 * (eid % 3)).alias("spot_y"),
        F.when(ok, F.col("value") * 10).alias("intensity"),
        F.when(ok, 1 + 0.25 * (eid % 5)).alias("sigma"),
        F.when(ok, F.col("value")).alias("peak"),
        (eid % 11).cast("double").alias("background"),
        F.col("event_type").alias("tag"),
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Sign-up events are the anchors of a trajectory."""
    p = points(spark, d).where("tag = 'signup'")
    return p.select("movie", "trajectory", "frame", F.col("search_x").alias("x"), F.col("search_y").alias("y"))


def movies(spark: SparkSession, d: str) -> DataFrame:
    """One movie per remainder of the trajectory number; m2 has no scale."""
    m = table(spark, d, "events").select((_trajectory() % 3).alias("m")).distinct()
    scaled = F.col("m") < 2
    return m.select(
        F.concat(F.lit("m"), F.col("m").cast("string")).alias("movie"),
        F.lit(512).alias("n_frames"),
        F.lit(256).alias("height"),
        F.lit(256).alias("width"),
        F.lit(2).alias("n_channels"),
        F.when(scaled, 100.0 + 10 * F.col("m")).alias("pixel_size_nm"),
        F.when(scaled, F.lit(50.0)).alias("frame_interval_ms"),
    )


def rois(spark: SparkSession, d: str) -> DataFrame:
    """Every customer is a line of five vertices; most have no trajectory."""
    c = F.col("c_custkey")
    ks = F.sequence(F.lit(0), F.lit(4))
    return table(spark, d, "customer").select(
        F.concat(F.lit("m"), (c % 3).cast("string")).alias("movie"),
        c.alias("roi"),
        F.lit("polyline").alias("type"),
        F.transform(ks, lambda k: (c * 17 % 256 + k * (c % 5 + 3) * 2).cast("double")).alias("x"),
        F.transform(ks, lambda k: (c * 29 % 256 + k * (c % 7 - 3) * 3).cast("double")).alias("y"),
    )


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Twenty embeddings of 64 floats are one 20 x 64 frame."""
    g = F.floor(F.col("vec_id") / 20)
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    w = F.col("e").cast("double") * 10
    return e.select(
        F.concat(F.lit("m"), (g % 2).cast("string")).alias("movie"),
        (1 + F.floor(g / 2) % 2).cast("int").alias("channel"),
        F.floor(g / 4).cast("int").alias("frame"),
        (F.col("vec_id") % 20).cast("int").alias("y"),
        F.col("pos").cast("int").alias("x"),
        (F.floor(w * w * w * w * 100) + 100).cast("double").alias("v"),
    )


def pixel_movies(spark: SparkSession, d: str) -> DataFrame:
    """Frame counts and sizes of the movies in ``pixels``."""
    g = F.floor(F.col("vec_id") / 20)
    return (
        table(spark, d, "embeddings")
        .groupBy(F.concat(F.lit("m"), (g % 2).cast("string")).alias("movie"))
        .agg((F.max(F.floor(g / 4)) + 1).cast("int").alias("n_frames"))
        .withColumns(
            {
                "height": F.lit(20),
                "width": F.lit(64),
                "n_channels": F.lit(2),
                "pixel_size_nm": F.lit(200.0),
                "frame_interval_ms": F.lit(50.0),
            }
        )
    )


def windows(spark: SparkSession, d: str) -> DataFrame:
    """One search centre per embedding, inside the frame the embedding belongs to."""
    v = F.col("vec_id")
    g = F.floor(v / 20)
    return table(spark, d, "embeddings").select(
        F.concat(F.lit("m"), (g % 2).cast("string")).alias("movie"),
        (v % 20).alias("trajectory"),
        (1 + F.floor(g / 2) % 2).cast("int").alias("channel"),
        F.floor(g / 4).cast("int").alias("frame"),
        ((v * 7 % 60) + 0.5 * (v % 4)).cast("double").alias("search_x"),
        ((v * 7 % 18) + 0.5 * (v % 3)).cast("double").alias("search_y"),
    )


def pixel_rois(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier is a line of three vertices across the 20 x 64 frames."""
    s = F.col("s_suppkey")
    ks = F.sequence(F.lit(0), F.lit(2))
    return table(spark, d, "supplier").select(
        F.concat(F.lit("m"), (s % 2).cast("string")).alias("movie"),
        s.alias("roi"),
        F.transform(ks, lambda k: ((s * 7 + k * (s % 3 + 1) * 5) % 64).cast("double")).alias("x"),
        F.transform(ks, lambda k: ((s * 3 + k * (s % 4 + 1) * 2) % 20).cast("double")).alias("y"),
    )


def tracks(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.floor(o / 20).alias("kymo"),
        o.alias("track"),
        ((F.col("o_custkey") % 100).cast("double") / 100).alias("mean_prob"),
        (F.col("o_totalprice") / 100000).alias("score"),
        (F.col("o_custkey") % 20).cast("double").alias("t_span"),
    )


def track_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Repeated t within a track on purpose; ``pos`` is unique per track."""
    k = F.col("l_orderkey")
    return table(spark, d, "lineitem").select(
        F.floor(k / 20).alias("kymo"),
        k.alias("track"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 100 + F.col("l_quantity")).cast("long").alias("pos"),
        (F.col("l_linenumber") + 0.5 * (F.col("l_suppkey") % 2)).cast("double").alias("t"),
        F.col("l_quantity").alias("x"),
    )


SQL = {
    "fx_points": """
SELECT concat('m', t % 3) AS movie, t AS trajectory,
  CAST(1 + (t // 3) % 2 AS INT) AS channel, CAST(f + f // 13 AS INT) AS frame,
  CAST(event_id * 7 % 256 AS DOUBLE) AS search_x, CAST(event_id * 13 % 256 AS DOUBLE) AS search_y,
  CASE WHEN event_type <> 'error' THEN event_id * 7 % 256 + 0.25 * CAST(event_id % 4 AS DOUBLE) END AS spot_x,
  CASE WHEN event_type <> 'error' THEN event_id * 13 % 256 + 0.25 * CAST(event_id % 3 AS DOUBLE) END AS spot_y,
  CASE WHEN event_type <> 'error' THEN value * 10 END AS intensity,
  CASE WHEN event_type <> 'error' THEN 1 + 0.25 * CAST(event_id % 5 AS DOUBLE) END AS sigma,
  CASE WHEN event_type <> 'error' THEN value END AS peak,
  CAST(event_id % 11 AS DOUBLE) AS background, event_type AS tag
FROM (SELECT *, event_id // 8192 * 128 + event_id % 128 AS t, event_id % 8192 // 128 AS f FROM events) e""",
    "fx_nodes": """
SELECT movie, trajectory, frame, search_x AS x, search_y AS y FROM fx_points WHERE tag = 'signup'""",
    "fx_movies": """
SELECT concat('m', m) AS movie, 512 AS n_frames, 256 AS height, 256 AS width, 2 AS n_channels,
  CASE WHEN m < 2 THEN CAST(100 + 10 * m AS DOUBLE) END AS pixel_size_nm,
  CASE WHEN m < 2 THEN CAST(50 AS DOUBLE) END AS frame_interval_ms
FROM (SELECT DISTINCT (event_id // 8192 * 128 + event_id % 128) % 3 AS m FROM events) s""",
    "fx_rois": """
SELECT concat('m', c_custkey % 3) AS movie, c_custkey AS roi, 'polyline' AS type,
  list_transform(range(0, 5), lambda k: CAST(c_custkey * 17 % 256 + k * (c_custkey % 5 + 3) * 2 AS DOUBLE)) AS x,
  list_transform(range(0, 5), lambda k: CAST(c_custkey * 29 % 256 + k * (c_custkey % 7 - 3) * 3 AS DOUBLE)) AS y
FROM customer""",
    "fx_vertices": """
SELECT movie, roi, CAST(i AS INT) AS i, x[i + 1] AS x, y[i + 1] AS y
FROM (SELECT *, unnest(range(0, 5)) AS i FROM fx_rois) v""",
    "fx_segments": """
SELECT movie, roi, i, x0, y0, x1, y1, len,
  coalesce(sum(len) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum,
  sum(len) OVER (PARTITION BY roi) AS total
FROM (SELECT a.movie, a.roi, a.i, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1,
        sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len
      FROM fx_vertices a JOIN fx_vertices b ON a.roi = b.roi AND b.i = a.i + 1) s""",
    "fx_pixels": """
SELECT concat('m', (vec_id // 20) % 2) AS movie, CAST(1 + (vec_id // 40) % 2 AS INT) AS channel,
  CAST(vec_id // 80 AS INT) AS frame, CAST(vec_id % 20 AS INT) AS y, CAST(pos AS INT) AS x,
  CAST(floor(e * e * e * e * 100) + 100 AS DOUBLE) AS v
FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) * 10 AS e, unnest(range(0, 64)) AS pos FROM embeddings) g""",
    "fx_windows": """
SELECT concat('m', (vec_id // 20) % 2) AS movie, vec_id % 20 AS trajectory,
  CAST(1 + (vec_id // 40) % 2 AS INT) AS channel, CAST(vec_id // 80 AS INT) AS frame,
  CAST(vec_id * 7 % 60 AS DOUBLE) + 0.5 * CAST(vec_id % 4 AS DOUBLE) AS search_x,
  CAST(vec_id * 7 % 18 AS DOUBLE) + 0.5 * CAST(vec_id % 3 AS DOUBLE) AS search_y
FROM embeddings""",
    "fx_pixel_rois": """
SELECT concat('m', s_suppkey % 2) AS movie, s_suppkey AS roi,
  list_transform(range(0, 3), lambda k: CAST((s_suppkey * 7 + k * (s_suppkey % 3 + 1) * 5) % 64 AS DOUBLE)) AS x,
  list_transform(range(0, 3), lambda k: CAST((s_suppkey * 3 + k * (s_suppkey % 4 + 1) * 2) % 20 AS DOUBLE)) AS y
FROM supplier""",
    "fx_tracks": """
SELECT o_orderkey // 20 AS kymo, o_orderkey AS track, CAST(o_custkey % 100 AS DOUBLE) / 100 AS mean_prob,
  o_totalprice / 100000 AS score, CAST(o_custkey % 20 AS DOUBLE) AS t_span
FROM orders""",
    "fx_track_nodes": """
SELECT l_orderkey // 20 AS kymo, l_orderkey AS track,
  CAST(l_partkey * 100000 + l_suppkey * 100 + l_quantity AS BIGINT) AS pos,
  CAST(l_linenumber + 0.5 * CAST(l_suppkey % 2 AS DOUBLE) AS DOUBLE) AS t, l_quantity AS x
FROM lineitem""",
}
_NEEDS = {
    "fx_nodes": ["fx_points"],
    "fx_vertices": ["fx_rois"],
    "fx_segments": ["fx_vertices"],
}


def sql_with(names: str, body: str, **more: str) -> str:
    """``body`` preceded by the named views (and their inputs) as a WITH clause."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({t})" for n, t in more.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
