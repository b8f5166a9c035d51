"""Hand-computed cases and restatements in numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.config import KEY, FinderParams, Params
from trackloom.functions import geometry as H
from trackloom.functions import scalars as S
from trackloom.functions.smooth import edge_smooth as smooth_numpy
from trackloom.functions.spot import measure
from trackloom.operators import diffusion as D
from trackloom.operators import drift as DR
from trackloom.operators import measure as ME
from trackloom.operators import points as P
from trackloom.operators import rois as R
from trackloom.operators import segments as G
from trackloom.operators import smoothing as E
from trackloom.operators import spots as N
from trackloom.operators import steps as T
from trackloom.operators import summary as M
from trackloom.operators.neighbours import near_any

MOVIES = pd.DataFrame(
    {
        "movie": ["a", "b"],
        "n_frames": [100, 100],
        "height": [64, 64],
        "width": [64, 64],
        "n_channels": [1, 1],
        "pixel_size_nm": [100.0, None],
        "frame_interval_ms": [50.0, None],
    }
)


def points(frames, xs, ys=None, movie="a", trajectory=1, intensity=None):
    n = len(frames)
    ys = [0.0] * n if ys is None else ys
    return pd.DataFrame(
        {
            "movie": movie,
            "trajectory": trajectory,
            "channel": 1,
            "frame": frames,
            "search_x": [float(i) for i in range(n)],
            "search_y": 0.0,
            "spot_x": xs,
            "spot_y": ys,
            "intensity": [1000.0] * n if intensity is None else intensity,
            "sigma": 1.5,
        }
    )


def sdf(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pd.notna(pdf), None), schema=schema(pdf))


def schema(pdf):
    kinds = {"i": "bigint", "f": "double", "O": "string", "b": "boolean"}
    return ", ".join(f"{c} {kinds[t.kind]}" for c, t in pdf.dtypes.items())


def test_speed_uses_previous_row_and_never_bridges_a_missing_fit(spark):
    p = points([0, 1, 4, 5], [0.0, 3.0, np.nan, 5.0], [0.0, 4.0, np.nan, 5.0])
    got = P.speeds(sdf(spark, p)).orderBy("frame").toPandas()["speed"].tolist()
    assert math.isnan(got[0]) and got[1] == 5.0 and math.isnan(got[2]) and math.isnan(got[3])
    gap = points([0, 4], [0.0, 6.0])
    assert P.speeds(sdf(spark, gap)).orderBy("frame").toPandas()["speed"][1] == 6.0


def test_straight_line(spark):
    p = points(list(range(20)), [2.0 * i for i in range(20)])
    nodes = pd.DataFrame({"movie": "a", "trajectory": 1, "frame": [0, 19], "x": [0.0, 38.0], "y": [0.0, 0.0]})
    row = M.per_trajectory(sdf(spark, p.assign(search_x=p.spot_x)), sdf(spark, nodes), sdf(spark, MOVIES)).first()
    assert row.net_speed_px_frame == pytest.approx(2.0) and row.speed_px_frame == pytest.approx(2.0)
    assert (row.start_frame, row.end_frame, row.segments) == (1, 20, 1)
    assert row.distance_um == pytest.approx(3.8) and row.time_s == pytest.approx(0.95)
    fit = D.diffusion(sdf(spark, p), sdf(spark, MOVIES)).first()
    assert fit.alpha == pytest.approx(2.0)
    # MSD = 4 t^2 px^2: D = 1 px^2 / frame^2
    assert fit.d_um2_s == pytest.approx(0.1**2 / 0.05**2)


def test_missing_scale_keeps_pixel_columns(spark):
    p = points([0, 1, 2], [0.0, 1.0, 2.0], movie="b")
    nodes = pd.DataFrame({"movie": "b", "trajectory": 1, "frame": [0], "x": [0.0], "y": [0.0]})
    row = M.per_trajectory(sdf(spark, p), sdf(spark, nodes), sdf(spark, MOVIES)).first()
    assert row.speed_px_frame == 1.0 and row.speed_um_s is None and row.distance_um is None and row.segments == 0


def test_all_fits_failed(spark):
    p = points([0, 1, 2], [np.nan] * 3, [np.nan] * 3, intensity=[np.nan] * 3)
    nodes = pd.DataFrame({"movie": "a", "trajectory": 1, "frame": [0, 2], "x": [0.0, 1.0], "y": [0.0, 0.0]})
    row = M.per_trajectory(sdf(spark, p), sdf(spark, nodes), sdf(spark, MOVIES)).first()
    assert (row.total_points, row.valid_points) == (3, 0) and row.mean_intensity is None and row.median_intensity is None
    assert D.diffusion(sdf(spark, p), sdf(spark, MOVIES)).count() == 0
    assert T.edge_smooth(sdf(spark, p)).count() == 0


def test_segment_labels(spark):
    nodes = pd.DataFrame({"movie": "a", "trajectory": [1, 1, 1, 2], "frame": [5, 8, 8, 3], "x": 0.0, "y": 0.0})
    nodes = pd.concat([nodes, nodes.iloc[:1].assign(frame=12)])
    p = pd.concat([points(list(range(3, 15)), [0.0] * 12), points([0, 9], [0.0] * 2, trajectory=2), points([1], [0.0], trajectory=3)])
    got = G.label_segments(sdf(spark, p), sdf(spark, nodes)).toPandas()
    label = {(t, f): s for t, f, s in zip(got.trajectory, got.frame, got.segment)}
    assert [label[1, f] for f in (3, 5, 6, 8, 9, 12, 14)] == [1, 1, 1, 1, 2, 2, 2]
    assert label[2, 0] == 1 and label[2, 9] == 1 and pd.isna(label[3, 1])
    inside = G.in_segment_rows(sdf(spark, p), sdf(spark, nodes)).where("trajectory = 1")
    assert sorted((r.frame, r.segment) for r in inside.collect()) == [(f, 1 if f <= 8 else 2) for f in range(5, 13)]


def test_class_edges(spark):
    df = spark.createDataFrame([(0.5, 0.01), (0.9, 0.1), (1.1, 1.0), (1.5, 0.0)], "alpha double, d_um2_s double")
    got = [(r.alpha_class, r.d_class) for r in P.classify_diffusion(df).collect()]
    assert got == [(S.ALPHA_RANGES[i + 1][2], S.D_RANGES[(i + 1) % 4][2]) for i in range(4)]


def test_msd_in_small_blocks_equals_whole(spark):
    rng = np.random.default_rng(5)
    f = np.sort(rng.choice(400, 120, replace=False))
    p = sdf(spark, points(list(f), list(rng.normal(size=120).cumsum()), list(rng.normal(size=120).cumsum())))
    whole = D.msd(p).orderBy("lag").toPandas()
    cut = D.msd(p, tile=8, block=11).orderBy("lag").toPandas()
    pd.testing.assert_frame_equal(whole, cut)
    x = p.orderBy("frame").toPandas()[["spot_x", "spot_y"]].to_numpy()
    for lag in (1, 7):
        want = ((x[lag:] - x[:-lag]) ** 2).sum(axis=1).mean()
        assert whole.set_index("lag").loc[lag, "msd"] == pytest.approx(want)


def test_smoother_flat_and_two_levels(spark):
    flat, slope = smooth_numpy(np.full(50, 3.0), 15, 10)
    assert np.all(flat == 3.0) and np.all(slope == 0.0)
    assert np.all(smooth_numpy(np.full(50, 3.0), 15, 1, zero_compat=True)[0] == 0.0)
    # An exact plateau has two equal extrema side by side; a slight tilt leaves one.
    trace = [1000.0 + 0.01 * i for i in range(60)] + [200.0 + 0.03 * i for i in range(60)]
    p = sdf(spark, points(list(range(120)), [0.0] * 120, intensity=trace))
    steps = T.steps(T.edge_smooth(p)).orderBy("step").collect()
    assert len(steps) == 2 and steps[0].level == pytest.approx(1000, abs=2) and steps[1].level == pytest.approx(200, abs=2)
    assert steps[0].end_frame == steps[1].start_frame and abs(steps[0].end_frame - 60) <= 1
    bg = spark.createDataFrame([("a", 1, 50.0)], "movie string, trajectory long, fixed_background double")
    s = T.step_summary(T.steps(T.edge_smooth(p)), bg).first()
    assert s.n_steps == 2 and s.mean_step == pytest.approx(800, abs=3)
    assert s.mean_step_background == pytest.approx((800 + 150) / 2, abs=3)


def test_smoother_in_blocks_equals_whole(spark):
    rng = np.random.default_rng(2)
    y = np.r_[rng.normal(500, 30, 150), rng.normal(200, 30, 151)]
    p = sdf(spark, points(list(range(301)), [0.0] * 301, intensity=list(y)))
    got = T.edge_smooth(p, half=5, passes=3, tile=16, block=40).orderBy("frame").toPandas()
    want = smooth_numpy(y, 5, 3)
    np.testing.assert_allclose(got["smooth"], want[0], rtol=1e-12)
    np.testing.assert_allclose(got["slope"], want[1], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 11, 40])
def test_savgol_is_a_local_quadratic_fit(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n).cumsum()
    p = sdf(spark, points(list(range(n)), list(x)))
    got = E.savgol(E.interpolate_gaps(p, tile=4), block=12).orderBy("frame").toPandas()["smooth_x"]
    if n < 3:
        assert got.isna().all()
        return
    m = min(5, (n - 1) // 2)
    for i in range(n):
        c = min(max(i, m), n - 1 - m)
        k = np.arange(c - m, c + m + 1)
        assert got[i] == pytest.approx(np.polyval(np.polyfit(k - c, x[k], 2), i - c), abs=1e-8)


def test_gap_filling(spark):
    p = sdf(spark, points([0, 1, 2, 3, 4, 5], [np.nan, 1.0, np.nan, np.nan, 4.0, np.nan], [np.nan, 0.0, np.nan, np.nan, 6.0, np.nan]))
    got = E.interpolate_gaps(p).orderBy("frame").toPandas()
    np.testing.assert_allclose(got["fill_x"], [1, 1, 2, 3, 4, 4])
    np.testing.assert_allclose(got["fill_y"], [0, 0, 2, 4, 6, 6])


def test_drift_in_blocks_equals_a_walk(spark):
    rng = np.random.default_rng(9)
    n, ref = 80, 30
    x, y = rng.normal(size=n).cumsum(), rng.normal(size=n).cumsum()
    hit = rng.random(n) < 0.5
    hit[ref] = True
    want = np.zeros((n, 2))
    for order in (range(ref + 1, n), range(ref - 1, -1, -1)):
        cur, step = np.array([x[ref], y[ref]]), np.zeros(2)
        for i in order:
            if hit[i]:
                new = np.array([x[i], y[i]])
                step = new - cur
            else:
                new = cur + step
            want[i] = new - [x[ref], y[ref]]
            cur = new
    pdf = pd.DataFrame({"movie": "a", "frame": np.arange(n), "x": np.where(hit, x, np.nan), "y": np.where(hit, y, np.nan)})
    got = DR.drift_offsets(sdf(spark, pdf), ref, tile=8, block=4).orderBy("frame").toPandas()
    assert len(got) == n
    np.testing.assert_allclose(got[["dx", "dy"]], want, atol=1e-8)


def test_neighbours_match_brute_force_and_boundaries(spark):
    rng = np.random.default_rng(4)
    a = pd.DataFrame({"g": rng.integers(0, 3, 300), "id": np.arange(300), "x": rng.uniform(-20, 20, 300), "y": rng.uniform(-20, 20, 300)})
    b = pd.DataFrame({"g": rng.integers(0, 3, 200), "x": rng.uniform(-20, 20, 200), "y": rng.uniform(-20, 20, 200)})
    got = {r.id for r in near_any(sdf(spark, a), sdf(spark, b), ["g"], 3.0, ["id"]).collect()}
    m = a.merge(b, on="g")
    assert got == set(m[(m.x_x - m.x_y) ** 2 + (m.y_x - m.y_y) ** 2 <= 9].id)
    one = pd.DataFrame({"g": [0], "id": [1], "x": [0.0], "y": [0.0]})
    at = pd.DataFrame({"g": [0], "x": [4.0], "y": [0.0]})
    assert near_any(sdf(spark, one), sdf(spark, at), ["g"], 4.0, ["id"]).count() == 1
    assert near_any(sdf(spark, one), sdf(spark, at), ["g"], 4.0, ["id"], inclusive=False).count() == 0


def test_hot_cell_of_spots(spark):
    """Many spots on nearly one place in one frame: every one collides, none is lost."""
    n = 2000
    pdf = pd.concat([points([0], [10.0 + 1e-4 * i], trajectory=i) for i in range(n)])
    got = N.avoid_previous(sdf(spark, pdf))
    assert got.count() == n and got.where("spot_x is not null").count() == 1


def test_projection_round_trip_and_inversion(spark):
    rois = spark.createDataFrame(
        [("a", 1, "line", [0.0, 30.0, 30.0, 60.0], [0.0, 0.0, 0.0, 40.0]), ("a", 2, "line", [5.0, 5.0], [5.0, 5.0])],
        "movie string, roi long, type string, x array<double>, y array<double>",
    )
    anchors = spark.createDataFrame([("a", 1, 1, k, float(k)) for k in range(0, 80, 7)], "movie string, trajectory long, roi long, frame int, xk double")
    placed = R.anchors_to_nodes(anchors, rois)
    again = R.project_points(placed, rois, "x", "y").toPandas() if "xk" not in placed.columns else R.project_points(placed.drop("xk"), rois, "x", "y").toPandas()
    np.testing.assert_allclose(again["xk"], again["frame"], atol=1e-9)
    dot = anchors.withColumn("roi", F.lit(2).cast("long")).withColumns({"x": F.lit(1.0), "y": F.lit(1.0)}).drop("xk")
    assert R.project_points(dot, rois, "x", "y").where("xk is not null").count() == 0
    twice = R.invert_rois(R.invert_rois(rois, rois), rois)
    assert twice.select(*rois.columns).exceptAll(rois).count() == 0
    flipped = R.invert_anchors(R.invert_anchors(anchors, rois, rois), rois, rois)
    assert flipped.select(*anchors.columns).exceptAll(anchors).count() == 0
    assert H.arc_length(rois).where("roi = 1 and i = 3").first().arc == pytest.approx(80.0)


@pytest.fixture(scope="module")
def spot_pixels():
    """Three frames of 48 x 48 with one Gaussian spot each and small fixed noise."""
    yy, xx = np.mgrid[0:48, 0:48]
    rng = np.random.default_rng(11)
    out = []
    for f, (cx, cy) in enumerate([(20.3, 24.6), (21.1, 24.1), (22.4, 23.7)]):
        v = 100 + 800 * np.exp(-((xx - cx) ** 2 + (yy - cy) ** 2) / (2 * 1.8**2)) + rng.normal(0, 1, xx.shape)
        out.append(pd.DataFrame({"movie": "a", "channel": 1, "frame": f, "y": yy.ravel(), "x": xx.ravel(), "v": v.ravel()}))
    return pd.concat(out)


def test_measurement_finds_gaussians_and_equals_the_numpy_form(spark, spot_pixels):
    size = pd.DataFrame({"movie": ["a"], "height": [48], "width": [48], "pixel_size_nm": [200.0]})
    w = pd.DataFrame({"movie": "a", "channel": 1, "frame": [0, 1, 2], "trajectory": 1, "search_x": [21.0, 21.0, 24.5], "search_y": [24.0, 24.0, 22.5]})
    prm = Params(search_radius=10)
    got = ME.measure_spots(sdf(spark, w), sdf(spark, spot_pixels), sdf(spark, size), prm).orderBy("frame").toPandas()
    truth = [(20.3, 24.6), (21.1, 24.1), (22.4, 23.7)]
    for i, r in got.iterrows():
        assert (r.spot_x, r.spot_y) == pytest.approx(truth[i], abs=0.15)
        assert r.peak == pytest.approx(800, rel=0.1) and r.background == pytest.approx(100, rel=0.05)
        px = spot_pixels[spot_pixels.frame == i]
        ref = measure(px.y.to_numpy(), px.x.to_numpy(), px.v.to_numpy(), (w.search_x[i], w.search_y[i]), prm.crop, (48, 48), 2 * (200 / 2.355) / 200)
        assert (r.spot_x, r.spot_y, r.sigma, r.peak, r.background, r.intensity) == pytest.approx(ref, rel=1e-9)


def test_empty_window_has_no_spot(spark, spot_pixels):
    size = pd.DataFrame({"movie": ["a"], "height": [48], "width": [48], "pixel_size_nm": [200.0]})
    w = pd.DataFrame({"movie": "a", "channel": 1, "frame": [0, 9], "trajectory": 1, "search_x": [5.0, 5.0], "search_y": [5.0, 5.0]})
    got = ME.measure_spots(sdf(spark, w), sdf(spark, spot_pixels), sdf(spark, size), Params(search_radius=5))
    assert got.count() == 2 and got.where("spot_x is not null").count() == 0


def test_tracked_mode_does_not_depend_on_the_size_of_pages(spark, spot_pixels):
    from trackloom.plans.tracking import track_sequential

    size = pd.DataFrame({"movie": ["a"], "height": [48], "width": [48], "pixel_size_nm": [200.0]})
    w = pd.DataFrame({"movie": "a", "channel": 1, "frame": [0, 1, 2], "trajectory": 1, "search_x": [18.0, 18.0, 18.0], "search_y": [22.0, 22.0, 22.0]})
    runs = [
        track_sequential(sdf(spark, w), sdf(spark, spot_pixels), sdf(spark, size), Params(search_radius=10), page=n).orderBy("frame").toPandas()
        for n in (1, 2, 100)
    ]
    for r in runs[1:]:
        pd.testing.assert_frame_equal(runs[0], r)
    assert runs[0]["spot_x"].notna().all()
    d = np.hypot(runs[0].spot_x - 18, runs[0].spot_y - 22)
    share = np.exp(-0.5 * d / 20)
    np.testing.assert_allclose(runs[0].track_x, share * runs[0].spot_x + (1 - share) * 18)


def test_recompute_prefers_anchors_then_nodes_then_points(spark, spot_pixels):
    from trackloom.plans.recompute import recompute

    size = pd.DataFrame({"movie": ["a"], "height": [48], "width": [48], "pixel_size_nm": [200.0]})
    rois = spark.createDataFrame([("a", 1, [10.0, 40.0], [24.0, 24.0])], "movie string, roi long, x array<double>, y array<double>")
    anchors = spark.createDataFrame([("a", 1, 1, 0, 10.0), ("a", 1, 1, 2, 12.0)], "movie string, trajectory long, roi long, frame int, xk double")
    nodes = spark.createDataFrame([("a", 2, 0, 19.0, 24.0), ("a", 2, 2, 22.0, 24.0)], "movie string, trajectory long, frame int, x double, y double")
    own = spark.createDataFrame([("a", t, f, 21.0, 24.0) for t in (1, 2, 3) for f in (0, 2)], "movie string, trajectory long, frame int, search_x double, search_y double")
    trs = spark.createDataFrame([("a", t, 1, {"note": str(t)}) for t in (1, 2, 3)], "movie string, trajectory long, channel int, custom map<string,string>")
    got = recompute(anchors, rois, nodes, own, trs, sdf(spark, spot_pixels), sdf(spark, size), "independent", Params(search_radius=10), background=False)
    rows = got.orderBy("trajectory", "frame").collect()
    assert [(r.trajectory, r.frame) for r in rows] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0), (3, 2)]
    assert [r.search_x for r in rows[:3]] == pytest.approx([20.0, 21.0, 22.0]) and rows[4].search_x == pytest.approx(20.5)
    assert all(r.custom["note"] == str(r.trajectory) for r in rows)
    only = spark.createDataFrame([("a", 2)], "movie string, trajectory long")
    assert recompute(anchors, rois, nodes, own, trs, sdf(spark, spot_pixels), sdf(spark, size), "independent", Params(search_radius=10), only).count() == 3


def test_points_check(spark):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        P.normalise_points(spark.createDataFrame([(1, 2)], "trajectory long, frame int"))
    with pytest.raises(AnalysisException):
        P.normalise_points(spark.createDataFrame([(1.0,)], "search_x double"))


def test_permutation_does_not_matter(spark):
    rng = np.random.default_rng(8)
    p = pd.concat([points(list(range(30)), list(rng.normal(size=30)), trajectory=t) for t in range(4)])
    a = P.speeds(sdf(spark, p)).orderBy(*KEY, "frame").toPandas()
    b = P.speeds(sdf(spark, p.sample(frac=1, random_state=1)).repartition(7)).orderBy(*KEY, "frame").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_a_resting_spot_is_divided_by_frame(spark):
    rois = spark.createDataFrame([("a", 1, [0.0, 40.0], [0.0, 0.0]), ("b", 2, [0.0, 0.0], [0.0, 40.0])], "movie string, roi long, x array<double>, y array<double>")
    n = 30_000
    resting = spark.range(n).select(F.lit("a").alias("movie"), F.lit(1).alias("trajectory"), F.col("id").alias("frame"), F.lit(10.0).alias("x"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(9.0).alias("y"))
    odd = spark.createDataFrame([("a", 2, None, 10.0, 1.0), ("a", 2, 5, None, 1.0), ("b", 2, -7, 1.0, 30.0), ("c", 2, 5, 10.0, 1.0)], "movie string, trajectory int, frame long, x double, y double")
    points = resting.unionByName(odd)
    got = R.near_roi(points, rois, 2.0, run=100)
    assert got.columns == points.columns
    by = {(r.movie, r.trajectory): r.n for r in got.groupBy("movie", "trajectory").agg(F.count("*").alias("n")).collect()}
    assert by == {("a", 1): n // 3, ("a", 2): 1, ("b", 2): 1}
    # No task has to take more of a cell than one run of frames.
    p, _, _ = R._close(points, rois, 2.0, "x", "y", "frame", 100)
    assert p.groupBy("movie", "_cell", "_run").count().agg(F.max("count")).first()[0] <= 100
    assert got.exceptAll(R.near_roi(points, rois, 2.0)).count() == 0


def test_tracks_that_begin_at_one_place_are_divided(spark):
    rois = spark.createDataFrame([("a", 1, [0.0, 40.0], [0.0, 0.0]), ("a", 2, [10.0, 10.0], [0.0, 40.0])], "movie string, roi long, x array<double>, y array<double>")
    ends = spark.range(900).select(F.lit("a").alias("movie"), F.col("id").alias("trajectory"), F.lit(10.0).alias("start_x"), F.lit(1.0).alias("start_y"), F.when(F.col("id") % 2 == 0, 30.0).otherwise(10.0).alias("end_x"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(30.0).alias("end_y"))
    got = R.match_by_place(ends, rois, 2.0, run=50).select("trajectory", "roi").collect()
    assert sorted((r.trajectory, r.roi) for r in got) == [(t, 1 + t % 2) for t in range(900)]


def test_cells_of_lines_are_not_broadcast(spark, capsys):
    rois = spark.range(40).select(F.lit("a").alias("movie"), F.col("id").alias("roi"), F.array(F.lit(0.0), F.col("id") * 10.0).alias("x"), F.array(F.lit(0.0), F.lit(40.0)).alias("y"))
    points = spark.range(20).select(F.lit("a").alias("movie"), F.lit(1).alias("trajectory"), F.col("id").alias("frame"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    got = R.near_roi(points, rois, 1.5)
    got.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and not any("Broadcast" in line and ("LeftSemi" in line or "Inner" in line) for line in plan.splitlines())
    lines = [((0.0, 0.0), (r.x[1], 40.0)) for r in rois.collect()]

    def far(px, py):
        return min(math.dist((px, py), np.array(b) * min(1.0, max(0.0, (px * b[0] + py * b[1]) / (b[0] ** 2 + b[1] ** 2)))) for _, b in lines)

    assert sorted(r.frame for r in got.collect()) == [i for i in range(20) if far(i, 1.0) <= 1.5]


def test_a_line_goes_to_pieces_and_not_to_runs(spark):
    rois = spark.createDataFrame([("a", 1, [0.0, 40.0], [0.0, 0.0])], "movie string, roi long, x array<double>, y array<double>")

    def sent(step):
        ends = spark.range(100).select(F.lit("a").alias("movie"), (F.col("id") * step).alias("trajectory"), F.lit(10.0).alias("start_x"), F.lit(1.0).alias("start_y"))
        return R._close(ends, rois, 2.0, "start_x", "start_y", "trajectory", 50)[1].count()

    # As many starts in the cell, however far their numbers are apart.
    assert sent(1) <= 4 and sent(1000) <= 5


def test_records_of_one_roi_id_are_one_roi(spark):
    rois = spark.createDataFrame(
        [("a", 1, [0.0, 40.0], [0.0, 0.0]), ("a", 1, [0.0, 40.0], [90.0, 90.0]), ("a", 2, [5.0], [0.0]), ("a", 3, [0.0, 40.0], [0.0, 0.0]), ("a", 3, [0.0, 40.0], [0.0, 0.0]), (None, 4, [0.0, 40.0], [0.0, 0.0])],
        "movie string, roi long, x array<double>, y array<double>",
    )
    ends = spark.createDataFrame(
        [("a", 7, 5.0, 1.0, 9.0, 91.0), ("a", 8, 5.0, 1.0, 30.0, 1.0), ("a", 8, 5.0, 1.0, 30.0, 1.0), ("a", 9, None, 1.0, 30.0, 1.0), (None, 10, 5.0, 1.0, 30.0, 1.0)],
        "movie string, trajectory long, start_x double, start_y double, end_x double, end_y double",
    )
    got = R.match_by_place(ends, rois, 2.0)
    assert got.columns == ["movie", "roi", "trajectory", "start_x", "start_y", "end_x", "end_y"]
    assert sorted((r.trajectory, r.roi) for r in got.collect()) == [(7, 1), (8, 1), (8, 3), (8, 3)]


def _crossing_tracks(spark):
    """Nodes of two tables, with repeated frames, missing places and numbers; some kymographs have one track only."""
    rng = np.random.default_rng(5)

    def nodes(n):
        rows = [
            (int(k) if k else None, int(t) if t else None, int(f), None if x < 0.5 else float(x))
            for k, t, f, x in zip(rng.integers(0, 5, n), rng.integers(0, 6, n), rng.integers(0, 9, n), np.floor(rng.random(n) * 48) / 4)
        ]
        return spark.createDataFrame(rows, "kymo long, track long, t int, x double")

    return nodes(160), nodes(160)


def _rows(df):
    return sorted(tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def _without_ends(df):
    # Of repeated frames at an end any one may be taken.
    return _rows(df.drop("start_dx", "end_dx"))


def test_matching_gives_the_same_pairs_whole_or_in_cells(spark, monkeypatch):
    from trackloom.operators import tracks as K

    a, b = _crossing_tracks(spark)
    loose = FinderParams(match_overlap=0.2, match_mean_dx=3.0, match_p90_dx=6.0, loose_union=9.0)
    whole = _without_ends(K.match_tracks(a, b, loose))
    monkeypatch.setattr(K, "WHOLE", 0)
    assert whole == _without_ends(K.match_tracks(a, b, loose)) and len(whole) > 10
    monkeypatch.setattr(K, "WHOLE", 60)
    assert whole == _without_ends(K.match_tracks(a, b, loose))


def test_duplicates_of_tracks_are_judged_the_same_whole_or_in_cells(spark, monkeypatch):
    from trackloom.operators import tracks as K

    nodes, _ = _crossing_tracks(spark)
    rows = [(k, t, float(k * t % 3)) for k in (1, 2, 3, 4) for t in range(1, 6)] + [(1, 2, 2.0), (2, 3, 5.0), (3, 1, None), (None, 1, 1.0), (1, None, 1.0)]
    tracks = spark.createDataFrame(rows, "kymo long, track long, score double")
    whole = [sorted(map(str, K.dedupe_tracks(nodes, tracks, dx, 0.3).collect())) for dx in (1.0, 3.0)]
    monkeypatch.setattr(K, "WHOLE", 0)
    assert whole == [sorted(map(str, K.dedupe_tracks(nodes, tracks, dx, 0.3).collect())) for dx in (1.0, 3.0)]
    assert all(4 < len(w) < len(rows) for w in whole)


def test_tracks_of_small_kymographs_are_dealt_once(spark):
    from trackloom.operators import tracks as K

    a, b = _crossing_tracks(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = K.match_tracks(a, b)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange for each table; pairs and their frames never travel.
    assert plan.count("Exchange hashpartitioning") == 2
