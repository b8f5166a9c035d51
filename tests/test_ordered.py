"""Ordered helpers against plain pandas, with tiles and blocks far smaller than the keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.operators.ordered import (
    _dyadic,
    beside,
    in_blocks,
    interval_join,
    interval_lookup,
    laid_out,
    nearest,
    numbered,
    with_position,
)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    parts = []
    # Key 0 holds most rows; key 3 has one row; gaps leave whole tiles empty.
    for k, n in ((0, 400), (1, 37), (2, 60), (3, 1)):
        f = np.sort(rng.choice(3000, n, replace=False))
        parts.append(pd.DataFrame({"k": k, "f": f, "v": rng.normal(size=n), "ok": rng.random(n) < 0.15}))
    return pd.concat(parts, ignore_index=True)


def back(df):
    return df.toPandas().sort_values(["k", "f"]).reset_index(drop=True)


def test_position(spark, rows):
    got = back(with_position(spark.createDataFrame(rows), ["k"], "f", tile=16))
    assert got["pos"].tolist() == rows.groupby("k").cumcount().tolist()


@pytest.mark.parametrize("tile", [1, 16, 65536])
def test_nearest_row(spark, rows, tile):
    got = back(nearest(spark.createDataFrame(rows), ["k"], "f", prev={"p": "v"}, next={"n": "v"}, tile=tile))
    want = rows.groupby("k")["v"]
    pd.testing.assert_series_equal(got["p"], want.shift(1), check_names=False)
    pd.testing.assert_series_equal(got["n"], want.shift(-1), check_names=False)


@pytest.mark.parametrize("tile", [1, 16, 65536])
def test_nearest_matching_row(spark, rows, tile):
    got = back(
        nearest(spark.createDataFrame(rows), ["k"], "f", prev={"p": "f"}, next={"n": "f"}, where=F.col("ok"), tile=tile)
    )
    at = rows["f"].where(rows["ok"])
    before = at.groupby(rows["k"]).shift(1)
    pd.testing.assert_series_equal(got["p"], before.groupby(rows["k"]).ffill(), check_names=False, check_dtype=False)
    after = at.groupby(rows["k"]).shift(-1)
    pd.testing.assert_series_equal(got["n"], after.groupby(rows["k"]).bfill(), check_names=False, check_dtype=False)


def test_beside_and_blocks(spark, rows):
    df = with_position(spark.createDataFrame(rows), ["k"], "f", tile=16)
    got = back(beside(df, ["k"], prev={"p": "v"}, next={"n": "v"}, size=7))
    assert len(got) == len(rows)
    pd.testing.assert_series_equal(got["p"], rows.groupby("k")["v"].shift(1), check_names=False)
    pd.testing.assert_series_equal(got["n"], rows.groupby("k")["v"].shift(-1), check_names=False)
    sizes = in_blocks(df, before=2, after=3, size=7).groupBy("k", "_block").count().toPandas()["count"]
    assert sizes.max() <= 7 + 5


def test_interval_join(spark, rows):
    spans = pd.DataFrame({"k": [0, 0, 0, 2, 9], "a": [0, 500, 510, 100, 0], "z": [499, 700, 520, 2900, 10], "name": list("abcde")})
    got = interval_join(spark.createDataFrame(rows), spark.createDataFrame(spans), ["k"], "f", "a", "z", "left", bucket=32)
    got = got.toPandas()
    m = rows.merge(spans, on="k", how="left")
    inside = m[(m.f >= m.a) & (m.f <= m.z)]
    assert sorted(zip(got.k, got.f, got.name.fillna(""))) == sorted(
        list(zip(inside.k, inside.f, inside.name))
        + [(k, f, "") for k, f in zip(rows.k, rows.f) if (k, f) not in set(zip(inside.k, inside.f))]
    )


def test_long_interval_is_few_rows(spark):
    spans = spark.createDataFrame([(0, 2**31 - 1), (1, 2**31 - 1), (-5, 2**31 + 70), (64, 2**31 - 65), (127, 128), (7, 7), (9, 8)], "a long, z long")
    blocks = _dyadic(spans, "a", "z", 64).groupBy("a", "z").agg(F.count("*").alias("n"), F.sum(F.pow(F.lit(2.0), "_l")).alias("buckets"))
    got = {(r.a, r.z): (r.n, r.buckets) for r in blocks.collect()}
    assert (9, 8) not in got and got.pop((7, 7)) == (1, 1) and got.pop((127, 128)) == (2, 2)
    for (a, z), (n, buckets) in got.items():
        assert n < 64 and buckets == z // 64 - a // 64 + 1


@pytest.mark.parametrize("tile", [1, 16, 65536])
def test_interval_lookup(spark, rows, tile):
    spans = pd.DataFrame({"k": [0, 0, 0, 2, 9], "a": [0, 500, 710, 100, 0], "z": [499, 700, 2500, 2900, 10], "name": list("abcde")})
    got = back(interval_lookup(spark.createDataFrame(rows), spark.createDataFrame(spans), ["k"], "f", "a", "z", ["name"], tile))
    assert list(got.columns) == [*rows.columns, "name"]
    held = [next((s.name_ for s in spans.rename(columns={"name": "name_"}).itertuples() if s.k == r.k and s.a <= r.f <= s.z), None) for r in rows.itertuples()]
    assert got["name"].where(got["name"].notna(), None).tolist() == held
    pd.testing.assert_frame_equal(got[rows.columns], rows, check_dtype=False)


@pytest.mark.parametrize("tile", [1, 16, 65536])
def test_position_and_neighbours_in_one_pass(spark, rows, tile):
    got = back(nearest(spark.createDataFrame(rows), ["k"], "f", prev={"p": "v"}, next={"n": "v"}, tile=tile, pos="pos"))
    assert got["pos"].tolist() == rows.groupby("k").cumcount().tolist()
    pd.testing.assert_series_equal(got["p"], rows.groupby("k")["v"].shift(1), check_names=False)


def test_numbered_by_ranges(spark, rows):
    df = spark.createDataFrame(rows).repartition(7).withColumn("k", F.when(F.col("k") != 2, F.col("k")))
    got = numbered(laid_out(df, ["k"], ["f"], "test"), ["k"], "pos", "n").toPandas()
    for _, own in got.groupby("k", dropna=False):
        own = own.sort_values("f")
        assert own["pos"].tolist() == list(range(len(own))) and set(own["n"]) == {len(own)}
    one = numbered(laid_out(df.select("v"), [], ["v"], "test"), []).toPandas().sort_values("v")
    assert one["pos"].tolist() == list(range(len(rows)))
    assert numbered(laid_out(df.where("false"), ["k"], ["f"], "test"), ["k"]).count() == 0
