import pytest
from pyspark.sql import functions as F

from checks import views as V
from trackloom.config import KEY
from trackloom.operators.editing import custom_columns, set_value
from trackloom.plans.export import result_tables
from trackloom.sources import tables as T

D = "/root/testdata/sf0.001"


def test_spot_csv_keeps_every_numeric_row(spark, tmp_path):
    f = tmp_path / "spots.csv"
    f.write_text(
        "TRACK_ID,FRAME,POSITION_X,POSITION_Y,QUALITY\nTrack ID,Frame,X,Y,Quality\nID,Frame,X,Y,Q\n,,(micron),(micron),\n"
        "4,1,1.0,2.0,9\n4,2,1.5,2.5,9\nNone,3,1.0,1.0,9\n5,1,bad,1.0,9\n5,2,0.5,0.25,9\n"
    )
    got = T.read_spot_csv(spark, str(f), 250.0).orderBy("trajectory", "frame").collect()
    assert [(r.trajectory, r.frame, r.x, r.y) for r in got] == [(4, 0, 4.0, 8.0), (4, 1, 6.0, 10.0), (5, 1, 2.0, 1.0)]
    with pytest.raises(ValueError):
        T.spots_to_nodes(spark.createDataFrame([("1",)], "FRAME string"), 250.0)


def test_headers(spark):
    df = spark.createDataFrame([("1", "2", "x", "y")], "Start_Frame string, Trajectory string, Anchors string, `Kymo-Anchors` string")
    got = T.import_trajectories(df)
    assert got.columns == ["start_frame", "trajectory", "kymo_anchors"] and got.first().kymo_anchors == "y"
    part = spark.createDataFrame([("Yes", "No")], "`Colocalized w/any channel` string, `Colocalized w/ch1` string")
    assert T.drop_partial_coloc(part, 1).columns == part.columns and T.drop_partial_coloc(part, 2).columns == []
    seg = spark.createDataFrame([("m", "1.0", "2", "0.5", "")], "Movie string, Trajectory string, Segment string, `Diffusion D` string, Alpha string")
    assert tuple(T.import_segment_diffusion(seg).first()) == ("m", 1, 2, 0.5, None)
    assert custom_columns(["movie", "A [binary]", "B", "Ch. 2 co. %", "Ch. 3 co. %", "movie [value]"], ["movie"], 2) == [
        ("A [binary]", "A", "binary"),
        ("B", "B", "value"),
        ("Ch. 2 co. %", "Ch. 2 co. %", "coloc"),
    ]


def test_geometry_round_trip(spark):
    df = spark.createDataFrame(
        [("m", 1, "[[3, 1.5, 96.0]]", '{"type":"line","x":[0.0,1.0],"y":[2.0,3.0],"points":[[0.0,2.0],[1.0,3.0]]}', "[[5.0,6.0,4.0]]")],
        "movie string, trajectory long, kymo_anchors string, roi_json string, movie_anchors string",
    )
    nested = T.parse_geometry(df)
    assert nested.first().nodes[0].frame == 3
    again = T.parse_geometry(T.geometry_json(nested))
    assert again.first() == nested.first()
    bad = T.parse_geometry(df.withColumns({c: F.lit("{oops") for c in ("kymo_anchors", "roi_json", "movie_anchors")})).first()
    assert bad.anchors == [] and bad.roi is None and bad.nodes == []


def test_computed_columns_refuse_edits(spark):
    df = V.points(spark, D).select(*KEY).distinct().withColumn("custom", F.create_map(F.lit("a"), F.lit("b")))
    for col in ("α", "D (μm²/s)", "Ch. 2 co. %"):
        with pytest.raises(ValueError):
            set_value(df, col, df, "1")


def test_all_result_tables_are_written_and_read(spark, tmp_path):
    p = V.points(spark, D)
    tr = p.select(*KEY).distinct().withColumn("roi", F.col("trajectory"))
    out = result_tables(p, V.nodes(spark, D), tr, V.rois(spark, D), V.movies(spark, D), ("diffusion", "steps", "colocalisation"))
    T.write_tables(out, str(tmp_path))
    n = tr.count()
    per = spark.read.parquet(f"{tmp_path}/per_trajectory")
    assert per.count() == n and {"α", "Number of Steps", "Ch. 2 co. %"} <= set(per.columns)
    ch = spark.read.parquet(f"{tmp_path}/per_kymograph_channel")
    assert ch.where("channel = 2").count() == V.rois(spark, D).join(V.movies(spark, D), "movie").count()
    assert spark.read.parquet(f"{tmp_path}/aggregate").count() == 3
    back = T.import_points(spark.read.parquet(f"{tmp_path}/points"), 2)
    assert back.select("movie", "trajectory", "frame").exceptAll(p.select("movie", "trajectory", "frame")).count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_tables_come_back_as_they_were(spark, tmp_path, fmt):
    even = F.col("trajectory") % 2 == 0
    p = V.points(spark, D).drop("tag").withColumns(
        {"from_trajectory": F.when(even, "Yes").otherwise("No"), "background": F.when(even, 7.0).otherwise(F.col("background"))}
    )
    tr = p.select(*KEY).distinct().withColumn("roi", F.col("trajectory"))
    fields = tr.select(*KEY, F.lit("movie").alias("clicks"), F.create_map(F.lit("good"), F.lit("x"), F.lit("group"), F.col("roi").cast("string")).alias("custom"))
    anchors = tr.select(*KEY, "roi", F.lit(2).alias("frame"), F.lit(3.5).alias("xk"))
    movies = V.movies(spark, D).withColumn("n_channels", F.when(F.col("movie") == "m0", 1).otherwise(2))
    out = result_tables(p, V.nodes(spark, D), tr, V.rois(spark, D), movies, ("diffusion", "steps", "colocalisation"), anchors=anchors, fields=fields)
    T.write_tables(out, str(tmp_path / fmt), fmt, kinds={"good": "binary", "group": "value"})
    back = T.read_tables(spark, str(tmp_path / fmt), 2, fmt)

    def same(a, b, cols):
        a, b = (x.select(*cols) for x in (a, b))
        assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0

    measured = ["movie", "trajectory", "frame", "channel", "segment", "search_x", "spot_x", "spot_y", "intensity", "background", "speed", "step", "level_adjusted", "coloc", "coloc_ch2"]
    same(out["points"], back["points"], measured)
    per = out["per_trajectory"].drop("roi").withColumnRenamed("roi_shape", "roi")
    per = per.withColumn("nodes", F.coalesce("nodes", F.array().cast("array<struct<frame:int,x:double,y:double>>")))
    same(
        per.withColumn("custom", F.to_json("custom")).withColumn("roi", F.to_json("roi")),
        back["per_trajectory"].withColumn("custom", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("custom"))))).withColumn("roi", F.to_json("roi")),
        [*KEY, "start_frame", "total_points", "background", "n_steps", "mean_step_background", "d_um2_s", "alpha", "ch2_pct", "clicks", "custom", "anchors", "nodes", "roi"],
    )
    same(out["per_segment"].where("d_um2_s IS NOT NULL"), back["segment_diffusion"].where("d_um2_s IS NOT NULL"), [*KEY, "segment", "d_um2_s", "alpha"])
    same(movies.where("pixel_size_nm IS NOT NULL"), back["movies"].where("pixel_size_nm IS NOT NULL"), ["movie", "pixel_size_nm", "frame_interval_ms"])
    # A movie of one channel has no share for a second one, and the last step to the background counts.
    assert out["per_trajectory"].where("movie = 'm0' AND ch2_pct IS NOT NULL").count() == 0
    assert out["per_trajectory"].where("n_steps > 1 AND background IS NOT NULL AND mean_step_background <> mean_step").count() > 0
    assert {"n_steps", "ch2_pct", "node_start_x", "node_end_y"} <= set(out["per_segment"].columns)


def test_read_pixels_prunes_channels(spark, tmp_path):
    V.pixels(spark, D).write.partitionBy("movie", "channel").parquet(str(tmp_path / "px"))
    df = T.read_pixels(spark, str(tmp_path / "px"), channel=2, frames=(0, 1))
    assert df.count() == V.pixels(spark, D).where("channel = 2 and frame <= 1").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(channel" in plan and "PushedFilters: [IsNotNull(frame)" in plan
