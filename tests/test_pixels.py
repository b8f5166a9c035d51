"""Pixels that are dropped before a shuffle, whole-image histograms, folds over long arrays."""

import math
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as H
from trackloom.functions.folds import running
from trackloom.operators import drift as DR
from trackloom.operators import pixels as X


def _pixels(spark, seed=1, side=40):
    rng = np.random.default_rng(seed)
    rows = [("a", 1, f, y, x, float(rng.integers(0, 500))) for f in range(4) for y in range(side) for x in range(side)]
    rows += [("b", 1, 0, y, x, 7.0) for y in range(3) for x in range(5)]
    return spark.createDataFrame(rows, "movie string, channel int, frame int, y int, x int, v double")


def _windows(spark, rows):
    return spark.createDataFrame(rows, "movie string, channel int, frame int, trajectory long, search_x double, search_y double")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_crops_equal_a_plain_selection_and_null_centres_have_none(spark):
    windows = [("a", 1, 2, 1, 3.5, 20.0), ("a", 1, 2, 2, 39.0, 39.0), ("a", 1, 3, 1, None, 5.0), ("z", 1, 2, 1, 9.0, 9.0)]
    pixels = _pixels(spark)
    got = {(r.trajectory, r.frame, r.y, r.x): r.v for r in X.search_crops(_windows(spark, windows), pixels, 6).collect()}
    want = {}
    for r in pixels.where("movie = 'a' AND frame = 2").collect():
        for t, cx, cy in ((1, 4, 20), (2, 39, 39)):
            if cx - 6 <= r.x < cx + 6 and cy - 6 <= r.y < cy + 6:
                want[t, 2, r.y, r.x] = r.v
    assert got == want and len(want) == 10 * 12 + 7 * 7


def test_types_of_the_keys_do_not_matter_to_the_filter(spark):
    windows = _windows(spark, [("a", 1, 2, 1, 20.0, 20.0)]).withColumns({"frame": F.col("frame").cast("long"), "channel": F.col("channel").cast("long")})
    assert X.search_crops(windows, _pixels(spark), 6).count() == 144


def test_untouched_blocks_are_dropped_below_the_exchange(spark, tmp_path):
    _pixels(spark).write.parquet(str(tmp_path / "px"))
    stored = spark.read.parquet(str(tmp_path / "px"))
    windows = _windows(spark, [("a", 1, 2, 1, 20.0, 20.0)])
    query = X.search_crops(windows, stored, 6)._jdf.queryExecution()
    text = query.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    tree = text.split("\n\n")[0].splitlines()
    scan = next(i for i, t in enumerate(tree) if "Scan parquet" in t)
    exchange = max([i for i, t in enumerate(tree[:scan]) if "Exchange" in t], default=0)
    filters = [re.search(r"\((\d+)\)", t).group(1) for t in tree[exchange:scan] if "Filter" in t]
    assert any("subquery" in text.split(f"\n({k}) Filter")[1].split("\n\n")[0].lower() for k in filters)
    blocks = windows.select("movie", "channel", "frame", F.lit(1).alias("_by"), F.lit(1).alias("_bx"))
    placed = stored.withColumns({"_bx": F.floor(F.col("x") / 16), "_by": F.floor(F.col("y") / 16)})
    assert placed.where(X.touched_blocks(blocks)).count() == 256
    assert placed.where(X.touched_blocks(blocks.limit(0))).count() == 0


def test_whole_image_histogram(spark):
    pixels = _pixels(spark).unionByName(spark.createDataFrame([("a", 1, 0, 0, 0, None)], _pixels(spark).schema))
    got = X.image_histogram(pixels).collect()
    for f in range(4):
        v = [r.v for r in pixels.where(f"movie = 'a' AND frame = {f} AND v IS NOT NULL").collect()]
        counts, _ = np.histogram(v, bins=50)
        have = {r.bin: r.pixels for r in got if r.movie == "a" and r.frame == f}
        assert [have.get(k, 0) for k in range(50)] == counts.tolist()
    assert [(r.bin, r.pixels) for r in got if r.movie == "b"] == [(25, 15)]
    assert X.image_histogram(pixels.limit(0)).count() == 0


def test_windows_without_a_centre_get_the_whole_image(spark):
    pixels = _pixels(spark)
    windows = _windows(spark, [("a", 1, 0, 1, 20.0, 20.0), ("a", 1, 1, 1, None, 3.0), ("a", 1, 1, 2, float("nan"), 3.0)])
    windows = windows.withColumn("sigma", F.lit(1.5))
    got = X.histograms(windows, pixels, 6).collect()
    image = {(r.bin, r.pixels) for r in X.image_histogram(pixels).where("movie = 'a' AND frame = 1").collect()}
    for t in (1, 2):
        own = [r for r in got if r.frame == 1 and r.trajectory == t]
        assert {(r.bin, r.pixels) for r in own} == image and all(r.core_pixels is None for r in own)
    assert sum(r.pixels for r in got if r.frame == 0) == 144
    assert sum(r.core_pixels for r in got if r.frame == 0) > 0


def test_running_states_equal_a_plain_fold(spark):
    rng = np.random.default_rng(5)
    values = {n: rng.normal(size=n).tolist() for n in (0, 1, 127, 128, 129, 1000)}
    df = spark.createDataFrame([(n, v) for n, v in values.items()] + [(-1, None)], "n int, v array<double>")
    for r in df.select("n", running(F.col("v"), F.lit(2.0), lambda a, b: a * 0.5 + b).alias("s")).collect():
        if r.n < 0:
            assert r.s is None
            continue
        want = [2.0]
        for b in values[r.n]:
            want.append(want[-1] * 0.5 + b)
        assert r.s == want


def test_a_line_of_100000_vertices(spark, tmp_path):
    n = 100_000
    k = np.arange(n)
    pdf = pd.DataFrame({"movie": ["a"], "roi": [1], "x": [(3.0 * k).tolist()], "y": [(4.0 * k).tolist()]})
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "roi"))
    roi = spark.read.parquet(str(tmp_path / "roi"))
    start = time.time()
    last = H.arc_length(roi).orderBy(F.desc("i")).first()
    line = H.lines(roi).select("total", F.element_at("segs", -1).alias("s")).first()
    assert (last.i, last.arc, line.total, line.s["cum"]) == (n - 1, 5.0 * (n - 1), 5.0 * (n - 1), 5.0 * (n - 2))
    assert time.time() - start < 30


def test_drift_needs_no_python(spark):
    track = spark.createDataFrame(pd.DataFrame({"movie": "a", "frame": range(9), "x": 1.0, "y": 2.0}))
    assert "Python" not in _plan(DR.drift_offsets(track, 0)) and "Pandas" not in _plan(DR.drift_offsets(track, 0))
    maps = DR._displacements(
        spark.createDataFrame([("a", k, k, 1.0, 1.0, 0.5, 0.5, float(k % 3)) for k in range(20)], "movie string, pos long, frame long, x double, y double, gx double, gy double, k double"),
        ["movie"],
        4,
    )
    assert maps.count() == 20


def test_kymograph_of_odd_rows_meets_in_blocks(spark):
    """Pixels that are missing, twice or without a value, ROI ids with several records, a line across blocks."""
    rng = np.random.default_rng(3)
    h, w = 45, 70
    rows = [("a", 1, f, y, x, float(rng.integers(1, 9))) for f in (0, 33) for y in range(h) for x in range(w) if rng.random() > 0.3]
    rows += rows[:40] + [("a", 1, 70, 20, 5, None), ("a", None, 1, 20, 6, 2.0), ("a", 1, 2, None, 3, 1.0), (None, 1, 2, 3, 3, 1.0), ("a", 1, 2, -1, 3, 1.0)]
    pixels = spark.createDataFrame(rows, "movie string, channel int, frame int, y int, x int, v double")
    lines = [("a", 1, [3.0, 66.0], [20.0, 21.5]), ("a", 2, [5.0, 5.0], [2.0, 44.0]), ("a", 2, [30.0, 60.0], [2.0, 40.0]), ("a", 3, [-4.0, 9.0], [-3.0, 50.0]), ("a", 3, [-4.0, 9.0], [-3.0, 50.0]), ("b", 4, [0.0, 9.0], [0.0, 9.0])]
    rois = spark.createDataFrame(lines, "movie string, roi long, x array<double>, y array<double>")
    movies = spark.createDataFrame([("a", h, w)], "movie string, height int, width int")

    def mirrored(i, n):
        j = i % (2 * n)
        return j if j < n else 2 * n - 1 - j

    by_place = {}
    for m, c, f, y, x, v in rows:
        if m == "a":
            by_place.setdefault((y, x), []).append((c, f, v))
    sums = {}
    for m, roi, (xa, xb), (ya, yb) in lines[:-1]:
        total = math.hypot(xb - xa, yb - ya)
        n = max(int(total), 2)
        nx, ny = -(yb - ya) / total, (xb - xa) / total
        for s in range(n):
            for o in range(-2, 3):
                sx, sy = xa + (xb - xa) * s / (n - 1) + nx * o, ya + (yb - ya) * s / (n - 1) + ny * o
                x0, y0 = math.floor(sx), math.floor(sy)
                for i in (0, 1):
                    for j in (0, 1):
                        k = (sx - x0 if i else 1 - sx + x0) * (sy - y0 if j else 1 - sy + y0)
                        for c, f, v in by_place.get((mirrored(y0 + j, h), mirrored(x0 + i, w)), []) if k > 1e-9 else []:
                            acc = sums.setdefault((roi, c, f, s), {})
                            if v is not None:
                                acc[o] = acc.get(o, 0.0) + k * v
    for method, of in (("max", lambda a: max(a.values(), default=None)), ("average", lambda a: sum(a.values()) / 5)):
        got = X.kymograph(pixels, rois, movies, method=method)
        found = {(r.roi, r.channel, r.frame, r.s): r.v for r in got.collect()}
        assert len(found) == got.count() and found.keys() == sums.keys()
        assert all(found[k] == pytest.approx(of(a), abs=1e-6) if of(a) is not None else found[k] is None for k, a in sums.items())
    # Only records of one id are added up behind the join; no side of it is broadcast.
    plan = _plan(X.kymograph(pixels, rois, movies))
    assert len(re.findall(r"\[partial_sum\(_o0", plan)) == 1 and plan.count("SortMergeJoin") == 2


def test_pages_hold_the_pixels_of_the_crops(spark):
    from trackloom.operators.pixels import crop_pages, crop_pixels

    rows = [("a", 1, f, y, x, None if (x + y) % 9 == 0 else float(x * y % 11)) for f in range(2) for y in range(11) for x in range(13)]
    pixels = spark.createDataFrame(rows + [("a", 1, 0, 5, 5, 3.0), (None, 1, 0, 5, 5, 3.0)], "movie string, channel int, frame int, y int, x int, v double")
    spots = [("a", t, 1, f, float(x), float(y), r) for f in range(2) for t, x, y, r in ((1, 5, 5, 2), (2, 0, 0, 3), (3, 12, 10, 40), (4, 30, 30, 2))]
    windows = spark.createDataFrame(spots, "movie string, trajectory long, channel int, frame int, cx double, cy double, r int")
    box = [F.col("cx") - F.col("r"), F.col("cx") + F.col("r"), F.col("cy") - F.col("r"), F.col("cy") + F.col("r")]
    for page in (4, 32):
        pages = crop_pages(windows, pixels, page, *box)
        got = sorted(
            (p.trajectory, p.frame, p.row * page + q.at // page, p.col * page + q.at % page, q.v) for p in pages.collect() for q in p._p
        )
        want = sorted((r.trajectory, r.frame, r.y, r.x, r.v) for r in crop_pixels(windows, pixels, *box).where("v IS NOT NULL").collect())
        assert got == want and len(got) > 200


def test_pixels_are_put_together_before_they_meet_windows(spark):
    from trackloom.config import Params
    from trackloom.plans.tracking import _pages

    pixels = spark.range(400).selectExpr("'a' AS movie", "1 AS channel", "0 AS frame", "CAST(id DIV 20 AS int) AS y", "CAST(id % 20 AS int) AS x", "CAST(id AS double) AS v")
    rows = spark.range(3).selectExpr("'a' AS movie", "id AS trajectory", "1 AS channel", "0 AS frame", "0L AS pos", "9.0 AS search_x", "9.0 AS search_y", f"{Params().crop} AS _r")
    plan = _pages(rows, pixels, 32)._jdf.queryExecution().optimizedPlan().toString()
    # The lists are made below the join: a list of joined pixels would hold a row for each pixel of each window.
    assert plan.index("Join") < plan.index("collect_list")


def test_places_of_lines_meet_frames_as_lists(spark):
    """A row for each place and frame of the join took some 50 microseconds each; lists of places meet groups of frames."""
    rows = [("a", 1, f, y, x, float(x + y + f)) for f in range(40) for y in range(40) for x in range(40)]
    pixels = spark.createDataFrame(rows, "movie string, channel int, frame int, y int, x int, v double")
    lines = [("a", k, [float(k % 30), 39.0], [0.0, 39.0 - k % 20]) for k in range(200)]
    rois = spark.createDataFrame(lines, "movie string, roi long, x array<double>, y array<double>")
    places = X._sampled(rois.withColumns({"_h": F.lit(40).cast("long"), "_w": F.lit(40).cast("long")}), "_h", "_w").withColumn("_part", F.lit(0).cast("bigint"))
    packs = X._packs(places.coalesce(1).select("movie", "roi", "s", "_part", *X._PLACE), 2).collect()
    blocks = X._tiled_pixels(pixels, 6).collect()
    assert sum(len(p.roi) for p in packs) == places.count() > 5_000 and len(packs) <= 4
    # Forty frames are two groups; four blocks with a rim of six pixels cover 40 x 40.
    assert len(blocks) == 8 and sum(len(b["_v"]) for b in blocks) == 40 * (38 + 8) ** 2
    movies = spark.createDataFrame([("a", 40, 40)], "movie string, height int, width int")
    got = {(r.roi, r.frame, r.s): r.v for r in X.kymograph(pixels, rois, movies, 0).collect()}
    assert len(got) == 40 * places.count()
    for p in places.where("_x < 39 and _y < 39 and s % 7 = 0").collect():
        assert got[p.roi, 33, p.s] == pytest.approx(p["_x"] + p["_y"] + 33)


def test_samples_take_known_pixels_of_some_weight_only():
    from trackloom.functions.sampling import corners, sampled

    place = {"_x": [-0.5, 2.25, np.nan], "_y": [1.0, 1.5, 0.0], "_nx": [0.0] * 3, "_ny": [1.0] * 3, "_h": [3] * 3, "_w": [4] * 3}
    xs, ys, ws = corners({c: np.array(v) for c, v in place.items()}, 0)
    assert xs[:, 0, 0].tolist() == [0, 0, 0, 0] and ys[:, 0, 0].tolist() == [1, 2, 1, 2]
    assert ws[:, 0, 1].tolist() == [0.375, 0.375, 0.125, 0.125] and np.isnan(ws[:, 0, 2]).all()
    at, weights = np.array([[[0, 2]], [[1, 3]]]), np.array([[[0.25, np.nan]], [[0.75, 0.0]]])
    values, known = np.array([[8.0, 4.0, 0.0, 0.0], [8.0, 0.0, 0.0, 0.0]]), np.array([[True, True, False, False], [True, False, False, False]])
    total, lacks = sampled(values, known, at, weights)
    assert total[:, 0].tolist() == [[5.0, 0.0], [2.0, 0.0]] and lacks[:, 0].tolist() == [[False, True], [False, True]]


def test_log_filter_deals_tiles_of_lists(spark, monkeypatch):
    """Missing, repeated and null samples, a ROI id with two sizes, lines and movies shorter than the kernel, tile borders."""
    rng = np.random.default_rng(8)
    rows = [("a", 1, 1, f, s, float(rng.integers(0, 99))) for f in range(19) for s in range(30) if rng.random() > 0.1]
    rows += rows[:9] + [("a", 2, 1, f, s, float(s * f % 5) if f else None) for f in range(12) for s in range(20)]
    rows += [("b", 3, c, f, s, float(rng.integers(0, 99))) for c in (1, 2) for f in range(2) for s in range(3)]
    rows += [("b", 4, 1, f, s, 0.0) for f in range(2) for s in range(9)] + [("b", 3, None, 0, 0, 1.0), ("z", 9, 1, 0, 0, 1.0)]
    sizes = [("a", 1, 30, 19), ("a", 1, 24, 19), ("a", 2, 20, 12), ("b", 3, 3, 2), ("b", 4, 9, 2)]
    kymo = spark.createDataFrame(rows, "movie string, roi long, channel int, frame int, s int, v double")
    table = spark.createDataFrame(sizes, "movie string, roi long, width int, n_frames int")
    g0, g2 = X._kernels(1.5)

    def tap(kernel, p, here):
        return kernel[abs(p - here)] if abs(p - here) < len(kernel) else 0.0

    def weight(kernel, q, here, n):
        return sum(tap(kernel, q + 2 * n * m, here) + tap(kernel, 2 * n * m - 1 - q, here) for m in range(-3, 4))

    want, found = {}, {}
    for key in {r[:3] for r in rows if r[2] is not None and r[0] != "z"}:
        own = [(f, s, w, n, v) for *k, f, s, v in rows if tuple(k) == key for m, o, w, n in sizes if (m, o) == key[:2]]
        # Within a sample's frame, then along the frames; repeated rows count twice.
        across = {}
        for f, s, w, *_ in set(own):
            near = [(t, v) for g, t, *_, v in own if g == f and abs(t - s) <= 6]
            across[f, s, w] = None if any(v is None for _, v in near) else tuple(sum(v * weight(k, t, s, w) for t, v in near) for k in (g0, g2))
        out = []
        for f, s, w, n, _ in own:
            near = [(g, across[g, t, u]) for g, t, u, *_ in own if t == s and abs(g - f) <= 6]
            out.append((f, s, None if any(a is None for _, a in near) else -sum(a[0] * weight(g2, g, f, n) + a[1] * weight(g0, g, f, n) for g, a in near)))
        known = [x for *_, x in out if x is not None]
        for f, s, x in out:
            lo, hi = min(known), max(known)
            want.setdefault((*key, f, s), []).append(None if x is None else (x - lo) / (hi - lo) * 254 + 1 if hi > lo else 128)
    dealt = []
    stage = X.stage
    monkeypatch.setattr(X, "stage", lambda df, name: dealt.append(_plan(df)) or stage(df, name))
    for block in (8, 512):
        found.clear()
        for r in X.log_filter(kymo, table, block=block).collect():
            found.setdefault((r.movie, r.roi, r.channel, r.frame, r.s), []).append(r.v)
        assert found.keys() == want.keys()
        for k, values in want.items():
            assert len(found[k]) == len(values)
            for a, b in zip(sorted(found[k], key=lambda v: (v is None, v)), sorted(values, key=lambda v: (v is None, v))):
                assert a is None if b is None else abs(a - np.floor(b)) <= (min(b % 1, 1 - b % 1) < 1e-6)
    assert {r for k, r in found.items() if k[1] == 2 and k[3] < 1 for r in r} == {None}
    assert {r for k, r in found.items() if k[1] == 4 for r in r} == {128}
    # Neighbours come as lists of a tile and not as a list for each row.
    assert len(dealt) == 2 and not any("Window" in p for p in dealt)
