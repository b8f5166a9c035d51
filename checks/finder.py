"""Candidate tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.lines import on_line
from checks.registry import register
from checks.views import sql_with
from trackloom.operators import tracks as K
from trackloom.operators.rois import anchors_to_nodes
from trackloom.plans.stages import stage

TK = "kymo:l track:l"

# Nodes reach frame 8, so a movie of nine frames holds them all.
FRAMES = 9
_CLEAN = """
SELECT kymo, track, t, x, {last} - t AS y FROM (
  SELECT *, count(*) OVER (PARTITION BY track) AS n FROM (
    SELECT kymo, track, CAST(round_even(t, 0) AS INT) AS t, arg_min(x, pos) AS x FROM {nodes}
    WHERE round_even(t, 0) BETWEEN 0 AND {last} GROUP BY ALL) o) c WHERE n >= 2"""
CLEAN = _CLEAN.format(nodes="fx_track_nodes", last=FRAMES - 1)


def clean(s, d):
    return K.clean_track_nodes(V.track_nodes(s, d), FRAMES)


def _outside(s, d):
    """Nodes of which some lie before the first frame and some behind the last one."""
    return V.track_nodes(s, d).withColumn("t", F.col("t") * 2 - 3)


def stored(s, d):
    """Matching reads its nodes several times."""
    return stage(clean(s, d), "clean-nodes")


register(
    "b8_clean_track_nodes",
    f"{TK} t:i x:d y:i",
    lambda s, d: K.clean_track_nodes(_outside(s, d), FRAMES),
    sql_with("fx_track_nodes", _CLEAN.format(nodes="outside", last=FRAMES - 1), outside="SELECT * REPLACE (t * 2 - 3 AS t) FROM fx_track_nodes"),
)
register(
    "b9_filter_tracks",
    f"{TK} confidence:d",
    lambda s, d: K.filter_tracks(V.tracks(s, d).withColumn("mean_prob", F.when(F.col("mean_prob") != 0.97, F.col("mean_prob") * 1.5)), 0.6),
    sql_with(
        "fx_tracks",
        """SELECT * FROM (SELECT kymo, track, CASE WHEN mean_prob = 0.97 THEN 0 ELSE least(1, greatest(0, mean_prob * 1.5)) END AS confidence
           FROM fx_tracks) t WHERE confidence >= 0.6""",
    ),
)
register(
    "b9_confidence_bounds",
    "kymo:l low:d high:d",
    lambda s, d: K.confidence_bounds(V.tracks(s, d)),
    sql_with("fx_tracks", "SELECT kymo, min(mean_prob) AS low, max(mean_prob) AS high FROM fx_tracks GROUP BY ALL"),
)

JUDGE = f"""
SELECT *, CASE WHEN span < 3 THEN 'reject_t_span' WHEN length < 4 THEN 'reject_length' WHEN step_speed < 1 THEN 'reject_vmin'
  WHEN directionality < 0.2 THEN 'reject_directionality' WHEN net_velocity < 0.5 THEN 'reject_net_velocity'
  WHEN mean_prob < 0.21 THEN 'reject_mean_prob' ELSE 'accepted' END AS verdict
FROM (SELECT kymo, track, max(t) - min(t) AS span, coalesce(sum(sqrt(dt * dt + dx * dx)), 0) AS length, avg(abs(dx) / dt) AS step_speed,
        CASE WHEN sum(abs(dx)) > 0 THEN abs(arg_max(x, t) - arg_min(x, t)) / sum(abs(dx)) ELSE 1 END AS directionality,
        abs(arg_max(x, t) - arg_min(x, t)) / (max(t) - min(t)) AS net_velocity
      FROM (SELECT *, t - lag(t) OVER w AS dt, x - lag(x) OVER w AS dx FROM ({CLEAN}) c WINDOW w AS (PARTITION BY track ORDER BY t)) s
      GROUP BY ALL) j JOIN fx_tracks USING (kymo, track)"""


def judged(s, d):
    return K.judge_tracks(clean(s, d), V.tracks(s, d), vmin=1.0, min_net_velocity=0.5)


register(
    "b21_judge_tracks",
    f"{TK} span:i length:d step_speed:d directionality:d net_velocity:d verdict:s",
    judged,
    sql_with("fx_track_nodes fx_tracks", JUDGE),
)
register(
    "b21_accept_tracks",
    TK,
    lambda s, d: K.accept_tracks(judged(s, d)),
    sql_with("fx_track_nodes fx_tracks", f"SELECT kymo, track FROM ({JUDGE}) q WHERE verdict = 'accepted'"),
)
register(
    "b21_verdict_counts",
    "verdict:s tracks:l",
    lambda s, d: K.verdict_counts(judged(s, d)),
    sql_with("fx_track_nodes fx_tracks", f"SELECT verdict, count(*) AS tracks FROM ({JUDGE}) q GROUP BY ALL"),
)

QUALITY = """
SELECT {g}, tracks, s + 0.12 * t + 0.35 * tm + 0.03 * tracks AS quality
FROM (SELECT {g}, count(*) AS tracks, sum(score) FILTER (WHERE rs <= 4) AS s, sum(t_span) FILTER (WHERE rt <= 4) AS t, max(t_span) AS tm
      FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY score DESC) AS rs, row_number() OVER (PARTITION BY {g} ORDER BY t_span DESC) AS rt
            FROM {src}) r GROUP BY ALL) q"""

register(
    "d16_track_set_quality",
    "kymo:l tracks:l quality:d",
    lambda s, d: K.track_set_quality(V.tracks(s, d)),
    sql_with("fx_tracks", QUALITY.format(g="kymo", src="fx_tracks")),
)


def _staged(s, d):
    return V.tracks(s, d).withColumn("stage", F.concat(F.lit("s"), (F.col("track") % 4).cast("string"))).withColumn(
        "length_px", F.col("t_span") * 2 + F.col("score")
    )


register(
    "d17_track_stage_stats",
    "stage:s tracks:l span_median:d length_median:d prob_median:d prob_p10:d",
    lambda s, d: K.track_stage_stats(_staged(s, d)),
    sql_with(
        "fx_tracks",
        """SELECT concat('s', track % 4) AS stage, count(*) AS tracks, median(t_span) AS span_median, median(t_span * 2 + score) AS length_median,
             median(mean_prob) AS prob_median, quantile_cont(mean_prob, 0.1) AS prob_p10 FROM fx_tracks GROUP BY ALL""",
    ),
)


def _modes(s, d):
    """Three passes per kymograph; some kymographs have no strict one."""
    t = V.tracks(s, d)
    third = F.col("track") % 10
    mode = F.when((third < 4) & (F.col("kymo") % 11 != 0), "strict").when(third < 7, "recover").otherwise("rescue")
    return t.withColumn("mode", mode)


MODES = """SELECT *, CASE WHEN track % 10 < 4 AND kymo % 11 <> 0 THEN 'strict' WHEN track % 10 < 7 THEN 'recover' ELSE 'rescue' END AS mode FROM fx_tracks"""
register(
    "d18_select_passes",
    "kymo:l mode:s tracks:l quality:d median_prob:d used:b",
    lambda s, d: K.select_passes(_modes(s, d)),
    sql_with(
        "fx_tracks",
        """SELECT p.*, CASE WHEN p.mode = 'strict' OR s.kymo IS NULL THEN true
             WHEN s.tracks >= 8 AND s.median_prob >= 0.11 THEN false
             WHEN p.tracks > greatest(s.tracks + 24, round_even(1.6 * s.tracks, 0)) AND p.quality <= 1.2 * s.quality THEN false
             ELSE p.median_prob >= greatest(0.85 * 0.12, 0.75 * s.median_prob, 0.08) END AS used
           FROM pass p LEFT JOIN (SELECT * FROM pass WHERE mode = 'strict') s ON s.kymo = p.kymo""",
        modes=MODES,
        **{"pass": f"SELECT * FROM ({QUALITY.format(g='kymo, mode', src='modes')}) q JOIN (SELECT kymo, mode, median(mean_prob) AS median_prob FROM modes GROUP BY ALL) m USING (kymo, mode)"},
    ),
)

STATS = """
SELECT s.kymo, s.track, s.other, mean_dx, p90_dx, shared / least(a.n, b.n) AS overlap, shared / (a.n + b.n - shared) AS overlap_union,
  abs(a.x0 - b.x0) AS start_dx, abs(a.x1 - b.x1) AS end_dx
FROM (SELECT a.kymo, a.track, b.track AS other, count(*) AS shared, avg(abs(a.x - b.x)) AS mean_dx, quantile_cont(abs(a.x - b.x), 0.9) AS p90_dx
      FROM {a} a JOIN {b} b ON a.kymo = b.kymo AND a.t = b.t GROUP BY ALL) s
JOIN (SELECT track, count(*) AS n, arg_min(x, t) AS x0, arg_max(x, t) AS x1 FROM {a} GROUP BY ALL) a ON a.track = s.track
JOIN (SELECT track, count(*) AS n, arg_min(x, t) AS x0, arg_max(x, t) AS x1 FROM {b} GROUP BY ALL) b ON b.track = s.other"""
MATCH = """(overlap >= 0.45 AND mean_dx <= 2.2 AND p90_dx <= 3.4) OR (overlap_union >= 0.35 AND start_dx <= 2.8 AND end_dx <= 2.8 AND p90_dx <= 4.0)"""


def shifted(nodes):
    """The same tracks seen by another stage, moved a little."""
    return nodes.withColumn("x", F.col("x") + 0.25 * (F.col("track") % 16))


def _matched(s, d):
    n = stored(s, d)
    return K.match_tracks(n, shifted(n))


def _fates(s, d):
    n = stored(s, d)
    later = shifted(n)
    return K.stage_fates(n, *[later.where(F.col("track") % 16 < k) for k in (13, 8, 4)])


register(
    "c10_match_tracks",
    f"{TK} other:l mean_dx:d p90_dx:d overlap:d overlap_union:d start_dx:d end_dx:d",
    _matched,
    sql_with(
        "fx_track_nodes",
        f"SELECT * FROM ({STATS.format(a='ca', b='cb')}) q WHERE {MATCH}",
        ca=CLEAN,
        cb=f"SELECT kymo, track, t, x + 0.25 * (track % 16) AS x FROM ca",
    ),
)
register(
    "c11_stage_fates",
    f"{TK} fate:s",
    _fates,
    sql_with(
        "fx_track_nodes",
        """SELECT kymo, track, CASE WHEN m IS NULL THEN 'lost_before_post_merge' WHEN e IS NULL THEN 'lost_before_post_extend'
             WHEN f IS NULL THEN 'lost_before_final' ELSE 'survived_final' END AS fate
           FROM (SELECT DISTINCT kymo, track FROM ca) t
           LEFT JOIN (SELECT track, max(CASE WHEN other % 16 < 13 THEN 1 END) AS m, max(CASE WHEN other % 16 < 8 THEN 1 END) AS e,
                        max(CASE WHEN other % 16 < 4 THEN 1 END) AS f FROM hit GROUP BY ALL) h USING (track)""",
        ca=CLEAN,
        cb="SELECT kymo, track, t, x + 0.25 * (track % 16) AS x FROM ca",
        hit=f"SELECT * FROM ({STATS.format(a='ca', b='cb')}) q WHERE {MATCH}",
    ),
)
DEDUPE = f"""SELECT * FROM fx_tracks WHERE track NOT IN (
  SELECT q.track FROM ({STATS.format(a='ca', b='ca')}) q JOIN fx_tracks a ON a.track = q.track JOIN fx_tracks b ON b.track = q.other
  WHERE q.track <> q.other AND mean_dx <= 6 AND overlap >= 0.5 AND (b.score > a.score OR b.score = a.score AND b.track < a.track))"""
register(
    "i8_dedupe_tracks",
    f"{TK} score:d",
    lambda s, d: K.dedupe_tracks(stored(s, d), V.tracks(s, d), 6.0, 0.5),
    sql_with("fx_track_nodes fx_tracks", DEDUPE, ca=CLEAN),
)
MERGED = """
SELECT *, row_number() OVER (PARTITION BY kymo ORDER BY score DESC, track) AS rank FROM d2"""


def dropped(src: str, a: float, b: float) -> str:
    return f"""SELECT q.track FROM ({STATS.format(a=f'(SELECT * FROM ca WHERE track IN (SELECT track FROM {src}))', b=f'(SELECT * FROM ca WHERE track IN (SELECT track FROM {src}))')}) q
      JOIN fx_tracks a ON a.track = q.track JOIN fx_tracks b ON b.track = q.other
      WHERE q.track <> q.other AND mean_dx <= {a} AND overlap >= {b} AND (b.score > a.score OR b.score = a.score AND b.track < a.track)"""


def _sets(s, d):
    n, t = clean(s, d), V.tracks(s, d)
    return [(t.where("track % 2 = 0"), n.where("track % 2 = 0")), (t.where("track % 2 = 1"), n.where("track % 2 = 1"))]


register(
    "f1_merge_track_sets",
    f"{TK} score:d rank:i",
    lambda s, d: K.merge_track_sets(_sets(s, d), max_tracks=10, max_dx=6.0, min_overlap=0.5),
    sql_with(
        "fx_track_nodes fx_tracks",
        f"SELECT * FROM ({MERGED}) m WHERE rank <= 10",
        ca=CLEAN,
        d1=f"SELECT * FROM fx_tracks WHERE track NOT IN ({dropped('fx_tracks', 1.3, 0.65)})",
        d2=f"SELECT * FROM d1 WHERE track NOT IN ({dropped('d1', 6, 0.5)})",
    ),
)
register(
    "g4_union_of_passes",
    f"{TK} score:d mode:s",
    lambda s, d: K.union_of_passes({m: _modes(s, d).where(F.col("mode") == m).drop("mode") for m in ("strict", "recover", "rescue")}),
    sql_with("fx_tracks", MODES),
)
register(
    "i9_path_mask",
    "kymo:l t:i x:i",
    lambda s, d: K.path_mask(clean(s, d), FRAMES, 51),
    sql_with(
        "fx_track_nodes",
        f"""SELECT DISTINCT kymo, t, x FROM (SELECT kymo, t, CAST(x AS INT) + unnest([-1, 0, 1]) AS x FROM ({CLEAN}) c) m WHERE x BETWEEN 0 AND 50""",
    ),
)


def _probs(s, d):
    """Probability of a kymograph cell: the largest discount of a node there."""
    return V.table(s, d, "lineitem").groupBy(
        F.floor(F.col("l_orderkey") / 20).alias("kymo"), F.col("l_linenumber").alias("t"), F.col("l_quantity").cast("int").alias("x")
    ).agg((F.max("l_discount") * 10).alias("p"))


register(
    "i14_link_fragments",
    f"{TK} other:l gap:i dx:d",
    lambda s, d: K.link_fragments(stored(s, d), _probs(s, d), 3, 4.0, 0.3, 0.5),
    sql_with(
        "fx_track_nodes",
        """SELECT a.kymo, a.track, a.other, a.gap, a.dx
           FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY gap, dx, other) AS r FROM ok) a
           JOIN (SELECT *, row_number() OVER (PARTITION BY other ORDER BY gap, dx, track) AS r FROM ok) b
             ON a.track = b.track AND a.other = b.other WHERE a.r = 1 AND b.r = 1""",
        ca=CLEAN,
        ends="SELECT kymo, track, min(t) AS t0, arg_min(x, t) AS x0, max(t) AS t1, arg_max(x, t) AS x1 FROM ca GROUP BY ALL",
        cand="""SELECT a.kymo, a.track, b.track AS other, a.t1, a.x1, b.x0, b.t0 - a.t1 AS gap, abs(a.x1 - b.x0) AS dx
                FROM ends a JOIN ends b ON a.kymo = b.kymo AND a.track <> b.track
                WHERE b.t0 - a.t1 BETWEEN 1 AND 3 AND abs(a.x1 - b.x0) <= 4""",
        probs="SELECT l_orderkey // 20 AS kymo, l_linenumber AS t, CAST(l_quantity AS INT) AS x, max(l_discount) * 10 AS p FROM lineitem GROUP BY ALL",
        ok="""SELECT * FROM cand WHERE gap = 1 OR (track, other) IN (
                SELECT (track, other) FROM (
                  SELECT c.track, c.other, coalesce(p.p, 0) AS p
                  FROM (SELECT *, unnest(range(1, gap)) AS k FROM cand WHERE gap > 1) c
                  LEFT JOIN probs p ON p.kymo = c.kymo AND p.t = c.t1 + c.k AND p.x = round_even(c.x1 + c.k * 1.0 / c.gap * (c.x0 - c.x1), 0)) q
                GROUP BY track, other HAVING avg(p) >= 0.3 AND avg(CASE WHEN p >= 0.3 THEN 1.0 ELSE 0.0 END) >= 0.5)""",
    ),
)


def _embeddings(s, d):
    """A direction per track, from its probability and score."""
    return V.tracks(s, d).select("kymo", "track", F.array(F.col("mean_prob") - 0.5, F.floor(F.col("score")) - 1.5).alias("embedding"))


register(
    "i14_link_fragments_alike",
    f"{TK} other:l gap:i dx:d",
    lambda s, d: K.link_fragments(stored(s, d), _probs(s, d), 1, 4.0, embeddings=_embeddings(s, d), min_similarity=0.5),
    sql_with(
        "fx_track_nodes fx_tracks",
        """SELECT a.kymo, a.track, a.other, 1 AS gap, a.dx
           FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY dx, other) AS r FROM alike) a
           JOIN (SELECT *, row_number() OVER (PARTITION BY other ORDER BY dx, track) AS r FROM alike) b
             ON a.track = b.track AND a.other = b.other WHERE a.r = 1 AND b.r = 1""",
        ca=CLEAN,
        ends="SELECT kymo, track, min(t) AS t0, arg_min(x, t) AS x0, max(t) AS t1, arg_max(x, t) AS x1 FROM ca GROUP BY ALL",
        vec="SELECT track, mean_prob - 0.5 AS u, floor(score) - 1.5 AS w FROM fx_tracks",
        alike="""SELECT a.kymo, a.track, b.track AS other, abs(a.x1 - b.x0) AS dx
                 FROM ends a JOIN ends b ON a.kymo = b.kymo AND a.track <> b.track AND b.t0 - a.t1 = 1 AND abs(a.x1 - b.x0) <= 4
                 JOIN vec p ON p.track = a.track JOIN vec q ON q.track = b.track
                 WHERE p.u * q.u + p.w * q.w >= 0.5 * sqrt((p.u * p.u + p.w * p.w) * (q.u * q.u + q.w * q.w))""",
    ),
)
register(
    "d18_single_pass",
    "kymo:l mode:s used:b",
    lambda s, d: K.select_passes(_modes(s, d), disable_fallback=True),
    sql_with("fx_tracks", "SELECT DISTINCT kymo, mode, mode = 'strict' AS used FROM modes", modes=MODES),
)
register(
    "i13_tracks_to_anchors",
    "trajectory:l frame:i xk:d x:d y:d source:s",
    lambda s, d: anchors_to_nodes(
        K.tracks_to_anchors(clean(s, d)).withColumn("movie", F.concat(F.lit("m"), (F.col("roi") % 3).cast("string"))),
        V.rois(s, d),
    ),
    sql_with(
        "fx_track_nodes fx_segments",
        on_line(
            "i13",
            f"""SELECT concat('m', kymo % 3) AS movie, kymo AS roi, track AS trajectory, t AS frame, x AS xk, 'finder' AS source
                FROM ({CLEAN}) c""",
        ),
    ),
)
