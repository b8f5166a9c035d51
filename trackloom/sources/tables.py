"""Reading and writing the interchange tables, pixels and spot lists."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.config import KEY
from trackloom.functions import scalars as S
from trackloom.operators.editing import read_custom_columns
from trackloom.operators.points import format_table

# Headers of the interchange tables and the column names used here.
POINT_HEADERS = {
    "Movie": "movie",
    "Trajectory": "trajectory",
    "Segment": "segment",
    "Channel": "channel",
    "Clicks": "clicks",
    "Frame": "frame",
    "Original Coordinate X": "orig_x",
    "Original Coordinate Y": "orig_y",
    "Search Center X": "search_x",
    "Search Center Y": "search_y",
    "Spot Center X": "spot_x",
    "Spot Center Y": "spot_y",
    "Intensity": "intensity",
    "Sigma": "sigma",
    "Peak": "peak",
    "Background from trajectory": "from_trajectory",
    "Background": "background",
    "Speed (px/frame)": "speed",
    "Speed (μm/s)": "speed_um_s",
    "Speed (μm/min)": "speed_um_min",
    "Step Number": "step",
    "Step Intensity Value": "level",
    "Step Intensity Value (background-adjusted)": "level_adjusted",
}
TRAJECTORY_HEADERS = {
    "Movie": "movie",
    "Trajectory": "trajectory",
    "Channel": "channel",
    "Start Frame": "start_frame",
    "End Frame": "end_frame",
    "Segments": "segments",
    "Kymo-Anchors": "kymo_anchors",
    "ROI": "roi_json",
    "Clicks": "clicks",
    "Movie-Anchors": "movie_anchors",
    "Total Points": "total_points",
    "Valid Points": "valid_points",
    "Percent Valid": "percent_valid",
    "Search Center X Start": "start_x",
    "Search Center Y Start": "start_y",
    "Search Center X End": "end_x",
    "Search Center Y End": "end_y",
    "Distance (μm)": "distance_um",
    "Time (s)": "time_s",
    "Background": "background",
    "Average Intensity": "mean_intensity",
    "Median Intensity": "median_intensity",
    "Net Speed (px/frame)": "net_speed_px_frame",
    "Net Speed (μm/s)": "net_speed_um_s",
    "Net Speed (μm/min)": "net_speed_um_min",
    "Avg. Speed (px/frame)": "speed_px_frame",
    "Avg. Speed (μm/s)": "speed_um_s",
    "Avg. Speed (μm/min)": "speed_um_min",
    "Number of Steps": "n_steps",
    "Average Step Size": "mean_step",
    "Average Step Size w/Step to Background": "mean_step_background",
    "D (μm²/s)": "d_um2_s",
    "α": "alpha",
}
# A segment's row has its nodes and frames instead of the trajectory's search centres.
_NOT_IN_SEGMENTS = ("Start Frame", "End Frame", "Segments", "Movie-Anchors", *(f"Search Center {c} {e}" for c in "XY" for e in ("Start", "End")))
SEGMENT_HEADERS = {
    "Segment": "segment",
    "Segment Start X": "node_start_x",
    "Segment Start Y": "node_start_y",
    "Segment Start Frame": "start_frame",
    "Segment End X": "node_end_x",
    "Segment End Y": "node_end_y",
    "Segment End Frame": "end_frame",
    **{h: n for h, n in TRAJECTORY_HEADERS.items() if h not in _NOT_IN_SEGMENTS},
}
MEAN_HEADERS = {
    "Average net speed (μm/s)": "mean_net_speed_um_s",
    "Average average speed (μm/s)": "mean_speed_um_s",
    "Average run length (μm)": "mean_run_length_um",
    "Average run time (s)": "mean_run_time_s",
    "Average median intensity": "mean_median_intensity",
    "Average average intensity": "mean_mean_intensity",
}
KYMOGRAPH_HEADERS = {
    "Movie": "movie",
    "Total distance (μm)": "total_distance_um",
    "Total time (s)": "total_time_s",
    "Number of trajectories": "n_trajectories",
    "Events (/min)": "events_per_min",
    "Events (/μm/min)": "events_per_um_per_min",
    **MEAN_HEADERS,
}
AGGREGATE_HEADERS = {
    "Movie": "movie",
    "Pixel size (nm/px)": "pixel_size_nm",
    "Frame time (ms)": "frame_interval_ms",
    "Total movie frames": "n_frames",
    "Total time (s)": "total_time_s",
    "Movie dimensions (px)": "dimensions_px",
    "Movie dimensions (μm)": "dimensions_um",
    "Total kymographs": "total_kymographs",
    "Summed kymograph distances (μm)": "total_distance_um",
    "Empty kymographs": "empty_kymographs",
    "Number of trajectories": "n_trajectories",
    "Number of events (/min)": "events_per_min",
    "Number of events (/um/min)": "events_per_um_per_min",
    **MEAN_HEADERS,
}
LEGACY_HEADERS = {
    "Start_Frame": "Start Frame",
    "End_Frame": "End Frame",
    "Anchors": "Kymo-Anchors",
    "Nodes": "Movie-Anchors",
}
D_HEADERS = ["D (μm²/s)", "D", "Diffusion D", "Diffusion D (µm²/s)", "Diffusion D (μm²/s)"]
ALPHA_HEADERS = ["α", "alpha", "Alpha"]
SCALE_HEADERS = {"Pixel size (nm/px)": "pixel_size_nm", "Frame time (ms)": "frame_interval_ms"}

# Fixed value: digits of the rounded columns.
_ROUNDED = 4
_ROUNDED_COLUMNS = (
    "percent_valid",
    *(f"{e}_{c}" for e in ("start", "end") for c in "xy"),
    *(f"{s}_{u}" for s in ("net_speed", "speed") for u in ("px_frame", "um_s", "um_min")),
)
_COLOC_SHARE = re.compile(r"^Ch\. (\d+) co\. %$")
_COLOC_FLAG = re.compile(r"^Colocalized w/(any channel|ch(\d+))$")
_INTS = {
    **dict.fromkeys(["trajectory", "total_points", "valid_points", "n_steps"], "bigint"),
    **dict.fromkeys(["segment", "channel", "frame", "step", "start_frame", "end_frame", "segments"], "int"),
}
_TEXTS = {"movie", "clicks", "from_trajectory", "kymo_anchors", "movie_anchors", "roi_json"}


def write_pixels(pixels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pixel table in folders of movie and channel; its files hold stretches of frames, which a reader can skip."""
    order = ["movie", "channel", "frame"]
    pixels.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("movie", "channel").parquet(path)


def read_pixels(spark: SparkSession, path: str, channel: int | None = None, frames: tuple[int, int] | None = None) -> DataFrame:
    """Pixel table partitioned by movie and channel; frames are low and high, both included."""
    df = spark.read.parquet(path)
    if channel is not None:
        df = df.where(F.col("channel") == channel)
    return df.where(F.col("frame").between(*frames)) if frames else df


def extract_scale(meta: DataFrame, description: str = "description", y_resolution: str = "y_resolution") -> DataFrame:
    """Pixel size (nm) and frame interval (ms) from image descriptions.

    A voxel size wins over the resolution tag, which is 'number/number' pixels
    per µm or a plain size in µm.  Values below 0.1 count as missing.
    """
    text, res = F.col(description), F.col(y_resolution)
    # How the file format writes voxel size and frame interval.
    voxel = F.regexp_extract(text, r"Voxel size:\s*([\d.]+)[xX]([\d.]+)[xX]([\d.]+)", 2)
    number = r"([\d.]+(?:[eE][+-]?\d+)?)"
    num = S.to_number(F.regexp_extract(res, rf"^\s*{number}\s*/\s*{number}\s*$", 1))
    den = S.to_number(F.regexp_extract(res, rf"^\s*{number}\s*/\s*{number}\s*$", 2))
    from_res = F.coalesce(den * 1000 / F.when(num != 0, num), S.to_number(res) * 1000)
    size = F.coalesce(S.to_number(voxel) * 1000, from_res)
    interval = S.to_number(F.regexp_extract(text, r"finterval=([\d.]+)", 1)) * 1000
    return meta.withColumn("pixel_size_nm", F.when(size >= 0.1, size)).withColumn(
        "frame_interval_ms", F.when(interval >= 0.1, interval)
    )


def spots_to_nodes(raw: DataFrame, pixel_size_nm: float, frame_base: int = 1) -> DataFrame:
    """Spot rows with text columns to nodes; rows without a numeric track, frame and place are left out.

    Positions are µm.  Node frames count from 0.
    """
    missing = {"TRACK_ID", "FRAME", "POSITION_X", "POSITION_Y"} - set(raw.columns)
    if missing:
        raise ValueError(f"spot list lacks {sorted(missing)}")
    px = pixel_size_nm / 1000
    out = raw.select(
        S.to_number(F.col("TRACK_ID")).cast("long").alias("trajectory"),
        (S.to_number(F.col("FRAME")).cast("int") - frame_base).alias("frame"),
        (S.to_number(F.col("POSITION_X")) / px).alias("x"),
        (S.to_number(F.col("POSITION_Y")) / px).alias("y"),
        F.lit("trackmate").alias("source"),
    )
    return out.dropna(subset=["trajectory", "frame", "x", "y"])


def read_spot_csv(spark: SparkSession, path: str, pixel_size_nm: float, frame_base: int = 1) -> DataFrame:
    """Spot list with one header and any number of text rows below it."""
    head = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in head)
    return spots_to_nodes(spark.read.schema(schema).option("header", True).csv(path), pixel_size_nm, frame_base)


def rename_headers(df: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    """Old headers to current ones, then to column names; a current header wins over an old one."""
    for old, new in LEGACY_HEADERS.items():
        if old in df.columns:
            df = df.drop(old) if new in df.columns else df.withColumnRenamed(old, new)
    return df.withColumnsRenamed({h: n for h, n in headers.items() if h in df.columns})


def _typed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    cols = []
    for c in df.columns:
        if c in names and c not in _TEXTS:
            n = S.to_number(F.col(f"`{c}`"))
            cols.append((n.cast(_INTS[c]) if c in _INTS else n).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return df.select(*cols)


def drop_partial_coloc(df: DataFrame, n_channels: int) -> DataFrame:
    """Colocalisation columns are kept only if all of them are there."""
    wanted = {"Colocalized w/any channel", *(f"Colocalized w/ch{c}" for c in range(1, n_channels + 1))}
    present = wanted & set(df.columns)
    return df.drop(*present) if present and present != wanted else df


def import_points(df: DataFrame, n_channels: int) -> DataFrame:
    """Points of an interchange table; table frames count from 1, frames here from 0."""
    out = _typed(rename_headers(drop_partial_coloc(df, n_channels), POINT_HEADERS), list(POINT_HEADERS.values()))
    flags = {c: "coloc" if m[2] is None else f"coloc_ch{m[2]}" for c in out.columns if (m := _COLOC_FLAG.match(c))}
    return out.withColumnsRenamed(flags).withColumn("frame", F.col("frame") - 1)


def import_trajectories(df: DataFrame, n_channels: int | None = None) -> DataFrame:
    """Trajectories of an interchange table; with ``n_channels`` their extra columns become the map ``custom``."""
    out = rename_headers(df, TRAJECTORY_HEADERS)
    shares = {c: f"ch{m[1]}_pct" for c in out.columns if (m := _COLOC_SHARE.match(c))}
    out = out.withColumnsRenamed(shares)
    known = [*TRAJECTORY_HEADERS.values(), *shares.values()]
    if n_channels is not None:
        out = read_custom_columns(out, [c for c in known if c in out.columns], n_channels)
    return _typed(out, known)


def import_scale(aggregate: DataFrame) -> DataFrame:
    """Movie, pixel size and frame interval of the aggregate table."""
    out = aggregate.withColumnRenamed("Movie", "movie")
    return out.select("movie", *[S.to_number(F.col(f"`{h}`")).alias(n) for h, n in SCALE_HEADERS.items()])


def import_segment_diffusion(df: DataFrame) -> DataFrame:
    """Stored D and alpha per segment under any of their headers."""

    def pick(names: list[str], alias: str) -> Column:
        for n in names:
            if n in df.columns:
                return S.to_number(F.col(f"`{n}`")).alias(alias)
        return F.lit(None).cast("double").alias(alias)

    out = df.select(
        F.col("Movie").alias("movie"),
        F.bround(S.to_number(F.col("Trajectory"))).cast("long").alias("trajectory"),
        F.bround(S.to_number(F.col("Segment"))).cast("int").alias("segment"),
        pick(D_HEADERS, "d_um2_s"),
        pick(ALPHA_HEADERS, "alpha"),
    )
    return out.where("trajectory is not null and segment is not null")


def read_tables(spark: SparkSession, folder: str, n_channels: int, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The tables written by ``write_tables`` or by older exports with the same headers."""

    def load(name: str) -> DataFrame:
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        return reader.format(fmt).load(f"{folder}/{name}")

    return {
        "points": import_points(load("points"), n_channels),
        "per_trajectory": parse_geometry(import_trajectories(load("per_trajectory"), n_channels)),
        "movies": import_scale(load("aggregate")),
        "segment_diffusion": import_segment_diffusion(load("per_segment")),
    }


def parse_geometry(df: DataFrame) -> DataFrame:
    """JSON text of anchors, ROI and movie anchors as nested columns; bad text gives none.

    Movie anchors [x, y, frame] count frames from 1 unless one of them is 0;
    frames below 1 stay as they are.
    """
    for c in ("kymo_anchors", "roi_json", "movie_anchors"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    anchors = F.from_json("kymo_anchors", "array<array<double>>")
    full = F.filter(F.coalesce(anchors, F.array().cast("array<array<double>>")), lambda a: F.size(a) == 3)
    kymo = F.transform(full, lambda a: F.struct(a[0].cast("int").alias("frame"), a[1].alias("xk"), a[2].alias("yk")))
    roi = F.from_json("roi_json", "type string, x array<double>, y array<double>, points array<array<double>>")
    raw = F.from_json("movie_anchors", "array<array<double>>")
    triples = F.filter(F.coalesce(raw, F.array().cast("array<array<double>>")), lambda a: (F.size(a) == 3) & a[2].isNotNull())
    based = F.transform(triples, lambda a: F.struct(F.bround(a[2]).cast("int").alias("f"), a[0].alias("x"), a[1].alias("y")))
    zero = F.exists(based, lambda a: a.f == 0)
    nodes = F.transform(
        F.filter(based, lambda a: a.x.isNotNull() & a.y.isNotNull()),
        lambda a: F.struct(
            F.when((a.f >= 1) & ~zero, a.f - 1).otherwise(a.f).alias("frame"), a.x.alias("x"), a.y.alias("y")
        ),
    )
    out = df.withColumn("anchors", kymo).withColumn("roi", F.when(roi.x.isNotNull(), roi)).withColumn("nodes", nodes)
    return out.drop("kymo_anchors", "roi_json", "movie_anchors")


def geometry_json(df: DataFrame) -> DataFrame:
    """Nested anchors, ROI and nodes as JSON text; node frames count from 1 there."""
    kymo = F.to_json(F.transform("anchors", lambda a: F.array(a.frame.cast("double"), a.xk, a.yk)))
    nodes = F.to_json(F.transform("nodes", lambda a: F.array(a.x, a.y, (a.frame + 1).cast("double"))))
    return (
        df.withColumn("kymo_anchors", kymo)
        .withColumn("roi_json", F.to_json("roi"))
        .withColumn("movie_anchors", nodes)
        .drop("anchors", "roi", "nodes")
    )


def export_headers(df: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    """Column names to the headers of the interchange table."""
    return df.withColumnsRenamed({n: h for h, n in headers.items() if n in df.columns})


def export_points(points: DataFrame) -> DataFrame:
    """Interchange table of points; frames count from 1 there."""
    out = points.withColumn("frame", F.col("frame") + 1)
    flags = {c: "Colocalized w/any channel" if c == "coloc" else f"Colocalized w/{c[6:]}" for c in out.columns if re.match(r"coloc(_ch\d+)?$", c)}
    return export_headers(out.withColumnsRenamed(flags), POINT_HEADERS)


def export_summary(df: DataFrame, headers: Mapping[str, str], kinds: Mapping[str, str] | None = None) -> DataFrame:
    """Interchange table per trajectory or segment.

    Nested cells become JSON text, shares and custom fields columns of their own; ``kinds`` gives the custom
    fields to write and whether each is 'binary' or 'value'.
    """
    if "anchors" in df.columns:
        nodes = F.col("nodes") if "nodes" in df.columns else F.lit(None).cast("array<struct<frame:int,x:double,y:double>>")
        df = geometry_json(df.drop("roi").withColumn("nodes", nodes).withColumnRenamed("roi_shape", "roi"))
    custom = [F.try_element_at("custom", F.lit(name)).alias(f"{name} [{kind}]") for name, kind in (kinds or {}).items()]
    df = format_table(df, {c: _ROUNDED for c in _ROUNDED_COLUMNS if c in df.columns})
    shares = {c: f"Ch. {m[1]} co. %" for c in df.columns if (m := re.match(r"ch(\d+)_pct$", c))}
    kept = [*[c for c in headers.values() if c in df.columns], *shares]
    return export_headers(df.select(*kept, *custom), headers).withColumnsRenamed(shares)


def interchange(results: Mapping[str, DataFrame], kinds: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Result tables with the headers, frame base and digits of the interchange format."""
    return {
        "points": export_points(results["points"]),
        "per_trajectory": export_summary(results["per_trajectory"], TRAJECTORY_HEADERS, kinds),
        "per_segment": export_summary(results["per_segment"], SEGMENT_HEADERS, kinds),
        "per_kymograph": export_headers(results["per_kymograph"], KYMOGRAPH_HEADERS),
        "per_kymograph_channel": export_headers(results["per_kymograph_channel"], KYMOGRAPH_HEADERS),
        "aggregate": export_headers(results["aggregate"], AGGREGATE_HEADERS),
    }


def write_tables(
    results: Mapping[str, DataFrame],
    folder: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    kinds: Mapping[str, str] | None = None,
) -> None:
    """One folder per table; per-kymograph results with a channel are split by channel."""
    for name, df in interchange(results, kinds).items():
        writer = df.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        if name == "per_kymograph_channel":
            writer = writer.partitionBy("channel")
        writer.save(f"{folder}/{name}")


def nodes_of(trajectories: DataFrame) -> DataFrame:
    """One row per node of the nested column."""
    return trajectories.select(*KEY, F.inline("nodes"))
