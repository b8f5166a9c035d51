"""Tracked mode against a walk over whole frames, backgrounds and reuse."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_jobs import sdf
from trackloom.config import Params
from trackloom.functions.spot import measure
from trackloom.plans.tracking import track, track_independent, track_sequential, track_smooth, with_background

FLOOR = 2 * (200 / 2.355) / 200


def frames(size, spots, seed=0):
    """Pixels of frames with Gaussian spots: ``spots[f]`` are (x, y, height)."""
    yy, xx = np.mgrid[0 : size[0], 0 : size[1]]
    rng, out = np.random.default_rng(seed), []
    for f, own in enumerate(spots):
        v = 100 + rng.normal(0, 1, xx.shape)
        for x, y, h in own:
            v += h * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * 1.8**2))
        out.append(pd.DataFrame({"movie": "a", "channel": 1, "frame": f, "y": yy.ravel(), "x": xx.ravel(), "v": v.ravel()}))
    return pd.concat(out)


def movie(size):
    return pd.DataFrame({"movie": ["a"], "height": [size[0]], "width": [size[1]], "pixel_size_nm": [200.0]})


def windows(centres, trajectory=1, background=None):
    w = pd.DataFrame({"movie": "a", "channel": 1, "frame": range(len(centres)), "trajectory": trajectory, "search_x": [float(c[0]) for c in centres], "search_y": [float(c[1]) for c in centres]})
    return w if background is None else w.assign(fixed_background=background)


def walk(w, px, size, params, background=None):
    """The mode's definition, with every frame whole."""
    cur, out = (w.search_x[0], w.search_y[0]), []
    for i, r in w.iterrows():
        f = px[px.frame == r.frame]
        found = measure(f.y.to_numpy(), f.x.to_numpy(), f.v.to_numpy(), cur, params.crop, size, FLOOR, background)
        ix, iy = r.search_x, r.search_y
        if found is None:
            cur = ((cur[0] + ix) / 2, (cur[1] + iy) / 2)
        else:
            k = math.exp(-0.5 * math.hypot(found[0] - ix, found[1] - iy) / params.crop)
            cur = (k * found[0] + (1 - k) * ix, k * found[1] + (1 - k) * iy)
        out.append((*cur, *(found or (math.nan,) * 6)))
    return np.array(out)


COLS = ["track_x", "track_y", "spot_x", "spot_y", "sigma", "peak", "background", "intensity"]


def test_a_miss_leaves_the_centre_far_from_the_next_one(spark):
    size = (64, 160)
    px, w = frames(size, [[], [], [(80, 32, 900)]]), windows([(20, 32), (140, 32), (140, 32)])
    got = track_sequential(sdf(spark, w), sdf(spark, px), sdf(spark, movie(size))).orderBy("frame").toPandas()
    assert (got.spot_x[2], got.spot_y[2]) == pytest.approx((80, 32), abs=0.1)
    np.testing.assert_allclose(got[COLS].to_numpy(float), walk(w, px, size, Params()), rtol=1e-9)


@pytest.mark.parametrize("background", [None, 95.0])
@pytest.mark.parametrize("seed", range(3))
def test_equals_a_walk_over_whole_frames(spark, seed, background):
    rng, size, n = np.random.default_rng(seed), (70, 130), 40
    at = np.cumsum(rng.normal(0, 3, (n, 2)), axis=0) + (65, 35)
    at += np.where(rng.random((n, 1)) < 0.15, rng.uniform(-60, 60, (n, 2)), 0)
    at = np.clip(at, 0, (129, 69))
    spots = [[] if rng.random() < 0.4 else [(x + rng.normal(0, 5), y + rng.normal(0, 5), 700)] for x, y in at]
    px, w = frames(size, spots, seed), windows(at, background=background)
    params = Params(search_radius=9)
    got = track_sequential(sdf(spark, w), sdf(spark, px), sdf(spark, movie(size)), params, page=8).orderBy("frame").toPandas()
    np.testing.assert_allclose(got[COLS].to_numpy(float), walk(w, px, size, params, background), rtol=1e-9)
    assert got.spot_x.notna().sum() > 5


def test_trajectories_that_span_batches_and_a_frame_without_a_centre(spark):
    rng, size, n = np.random.default_rng(5), (50, 90), 12
    px = frames(size, [[(30 + f, 25, 700)] for f in range(n)])
    own = {t: windows(np.column_stack([30 + np.arange(n) + rng.normal(0, 2, n), np.full(n, 25)]), t) for t in (1, 2, 3)}
    w = pd.concat(own.values())
    w.loc[(w.trajectory == 3) & (w.frame == 6), "search_x"] = np.nan
    gap = sdf(spark, w).withColumn("search_x", F.expr("nullif(search_x, double('NaN'))"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = track_sequential(gap, sdf(spark, px), sdf(spark, movie(size)), page=8).orderBy("frame").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = {t: g[COLS].to_numpy(float) for t, g in got.groupby("trajectory")}
    for t in (1, 2):
        np.testing.assert_allclose(got[t], walk(own[t], px, size, Params()), rtol=1e-9)
    assert np.isnan(got[3][6]).all()
    np.testing.assert_allclose(got[3][:6], walk(own[3][:6], px, size, Params()), rtol=1e-9)
    np.testing.assert_allclose(got[3][7:], walk(own[3][7:].reset_index(drop=True), px, size, Params()), rtol=1e-9)


def test_no_windows_no_track(spark):
    size = (50, 90)
    none = sdf(spark, windows([(30, 25)])).limit(0)
    assert track_sequential(none, sdf(spark, frames(size, [[]])), sdf(spark, movie(size))).count() == 0


def test_background_is_measured_once_and_held_in_every_mode(spark):
    size = (60, 60)
    px = frames(size, [[(30 + f, 30, 800)] for f in range(6)])
    w = windows([(30 + f, 30) for f in range(6)])
    given = with_background(sdf(spark, w), sdf(spark, px), sdf(spark, movie(size))).toPandas()
    level = given.fixed_background.unique()
    assert len(level) == 1 and level[0] == pytest.approx(100, abs=1)
    for mode in ("independent", "tracked", "smooth", "same-centre"):
        got = track(sdf(spark, w), sdf(spark, px), sdf(spark, movie(size)), mode).toPandas()
        assert (got.background == level[0]).all()


def test_reused_spots_go_in_all_modes(spark):
    size = (60, 60)
    px = frames(size, [[(30, 30, 800)] for _ in range(4)])
    w = pd.concat([windows([(30, 30)] * 4, t) for t in (1, 2)])
    for mode in (track_independent, track_sequential, track_smooth):
        got = mode(sdf(spark, w), sdf(spark, px), sdf(spark, movie(size)), avoid=True)
        found = {r.trajectory: r.n for r in got.groupBy("trajectory").agg(F.count("spot_x").alias("n")).collect()}
        assert found == {1: 4, 2: 0}


def test_found_tracks_become_measured_trajectories(spark):
    from trackloom.plans.finder import found_trajectories

    size = (60, 80)
    px = frames(size, [[(20 + 2 * f, 30, 800)] for f in range(7)])
    rois = spark.createDataFrame([("a", 4, [10.0, 70.0], [30.0, 30.0])], "movie string, roi long, x array<double>, y array<double>")
    # Places count along the line, which begins at x = 10; frames 1 to 2 and 4 to 5 lie between the nodes.
    nodes = spark.createDataFrame([(4, 9, 0, 10.0), (4, 9, 3, 16.0), (4, 9, 6, 22.0)], "kymo long, track long, t int, x double")
    got = found_trajectories(nodes, rois, sdf(spark, px), sdf(spark, movie(size)), mode="same-centre").orderBy("frame").collect()
    assert [(r.trajectory, r.frame, r.clicks) for r in got] == [(9, f, "finder") for f in range(7)]
    assert [r.spot_x for r in got] == pytest.approx([20 + 2 * f for f in range(7)], abs=0.2)
    assert len({r.background for r in got}) == 1
