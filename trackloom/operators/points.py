"""Per-point jobs: checks, fallbacks, speeds, units, status classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.config import KEY
from trackloom.functions import scalars as S
from trackloom.operators.ordered import TILE, nearest, with_position
from trackloom.operators.quantiles import exact_percentiles


def normalise_points(df: DataFrame) -> DataFrame:
    """Search centre from the original coordinate where missing, and the reverse."""
    missing = [c for c in ("trajectory", "frame") if c not in df.columns]
    if missing:
        raise AnalysisException(f"points need the columns {missing}")
    search, orig = ("search_x", "search_y"), ("orig_x", "orig_y")
    has_search, has_orig = set(search) <= set(df.columns), set(orig) <= set(df.columns)
    if not has_search and not has_orig:
        raise AnalysisException("points need a search centre or an original coordinate")
    for s, o in zip(search, orig):
        a = F.col(s) if has_search else F.lit(None).cast("double")
        b = F.col(o) if has_orig else F.lit(None).cast("double")
        df = df.withColumn("_s", F.coalesce(a, b)).withColumn("_o", F.coalesce(b, a))
        df = df.withColumn(s, F.col("_s")).withColumn(o, F.col("_o")).drop("_s", "_o")
    return df


def resolve_channel(points: DataFrame, n_channels: int) -> DataFrame:
    """One channel per trajectory: the smallest valid one; says how many were seen."""
    ok = F.when(F.col("channel").between(1, n_channels), F.col("channel"))
    return points.groupBy(*KEY).agg(
        F.min(ok).alias("channel"),
        F.min("channel").alias("_lo"),
        F.max("channel").alias("_hi"),
        F.count_if(ok.isNull()).alias("n_bad"),
    ).select(*KEY, "channel", (F.col("_lo") != F.col("_hi")).alias("mixed"), "n_bad")


def valid_points(points: DataFrame) -> DataFrame:
    return points.where(S.is_valid(F.col("intensity")))


def speeds(points: DataFrame, tile: int = TILE) -> DataFrame:
    """px/frame to the previous row; NULL on the first row and next to a missing spot."""
    out = nearest(points, KEY, "frame", prev={"_px": "spot_x", "_py": "spot_y"}, tile=tile)
    step = S.dist(F.col("_px"), F.col("_py"), F.col("spot_x"), F.col("spot_y"))
    return out.select(*points.columns, step.alias("speed"))


def with_units(df: DataFrame, movies: DataFrame, speed: str = "speed") -> DataFrame:
    """Speeds in µm/s and µm/min; NULL where the movie has no scale."""
    scale = movies.select("movie", "pixel_size_nm", "frame_interval_ms")
    out = df.join(scale, "movie", "left")
    v = S.um_per_s(F.col(speed), F.col("pixel_size_nm"), F.col("frame_interval_ms"))
    return (
        out.withColumn(f"{speed}_um_s", v)
        .withColumn(f"{speed}_um_min", v * 60)
        .drop("pixel_size_nm", "frame_interval_ms")
    )


def format_table(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round columns for output, half away from zero; NULL stays NULL."""
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def fixed_background(points: DataFrame) -> DataFrame:
    """The one background of a trajectory whose flags all say yes, else NULL.

    Rows need ``from_trajectory`` (text flag) and ``background``.
    """
    flag = F.lower(F.trim("from_trajectory"))
    return (
        points.groupBy(*KEY)
        .agg(
            F.min((flag == "yes").cast("int")).alias("_all"),
            F.min("background").alias("_lo"),
            F.max("background").alias("_hi"),
        )
        .select(
            *KEY,
            F.when((F.col("_all") == 1) & (F.col("_lo") == F.col("_hi")), F.col("_lo")).alias("fixed_background"),
        )
    )


def classify_diffusion(df: DataFrame, d: str = "d_um2_s", alpha: str = "alpha") -> DataFrame:
    return df.withColumn("alpha_class", S.range_class(F.col(alpha), S.ALPHA_RANGES)).withColumn(
        "d_class", S.range_class(F.col(d), S.D_RANGES)
    )


def fit_status() -> Column:
    return F.when(F.col("intensity").isNotNull(), "fitted").otherwise("unfitted")


def flag_status(flag: Column) -> Column:
    """Status of a tri-state Yes / No / NULL flag."""
    return F.when(flag == "Yes", "colocalised").when(flag == "No", "alone").otherwise("none")


def classify_points(points: DataFrame, by: str = "fit", segment_diffusion: DataFrame | None = None) -> DataFrame:
    """Add ``status``: by fit, by a colocalisation flag, by a mark, a value, or segment diffusion."""
    if by == "fit":
        return points.withColumn("status", fit_status())
    if by == "coloc":
        return points.withColumn("status", flag_status(F.col("coloc")))
    if by == "binary":
        marked = F.coalesce(F.trim("mark") != "", F.lit(False))
        return points.withColumn("status", F.when(marked, "marked").otherwise("unmarked"))
    if by == "value":
        return points.withColumn("status", F.coalesce(F.nullif(F.col("value"), F.lit("")), F.lit("none")))
    if by in ("segment_alpha", "segment_d"):
        col, ranges = ("alpha", S.ALPHA_RANGES) if by == "segment_alpha" else ("d_um2_s", S.D_RANGES)
        seg = segment_diffusion.select(*KEY, "segment", F.col(col).alias("_v"))
        return (
            points.join(seg, [*KEY, "segment"], "left")
            .withColumn("status", S.range_class(F.col("_v"), ranges))
            .drop("_v")
        )
    raise ValueError(f"cannot classify points by {by!r}")


def needs_recompute(points: DataFrame) -> DataFrame:
    """Trajectories whose frames are not contiguous, or every one if a column is absent."""
    absent = {"intensity", "sigma", "peak", "background"} - set(points.columns)
    per = points.groupBy(*KEY, "frame").agg(F.count(F.lit(1)).alias("_n"))
    span = per.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_frames"),
        F.sum("_n").alias("_rows"),
        (F.max("frame") - F.min("frame") + 1).alias("_span"),
    )
    if not absent:
        span = span.where((F.col("_frames") != F.col("_span")) | (F.col("_rows") != F.col("_span")))
    return span.select(*KEY)


def invalidate_points(points: DataFrame, marks: DataFrame) -> DataFrame:
    """NULL the fit of the marked (movie, trajectory, frame) rows."""
    cols = [c for c in ("spot_x", "spot_y", "sigma", "peak", "intensity", "coloc") if c in points.columns]
    keyed = marks.select(*KEY, "frame").distinct().withColumn("_hit", F.lit(True))
    out = points.join(keyed, [*KEY, "frame"], "left")
    for c in cols:
        out = out.withColumn(c, F.when(F.col("_hit").isNull(), F.col(c)))
    return out.drop("_hit")


def trace_stats(points: DataFrame) -> DataFrame:
    """Mean and median over all intensities that are not NULL, zeros included."""
    mean = points.groupBy(*KEY).agg(F.avg("intensity").alias("mean_intensity"))
    return mean.join(exact_percentiles(points, KEY, "intensity", {"median_intensity": 0.5}), KEY, "left")


def ordered(points: DataFrame) -> DataFrame:
    """Points by movie, trajectory and frame, for a table that people read."""
    return points.orderBy(*KEY, "frame")


def realign(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Recomputed points on the old frame list; frames without a result give NULLs."""
    return frames.select(*KEY, "frame").join(points, [*KEY, "frame"], "left")


def select_trajectories(points: DataFrame, ids: DataFrame) -> DataFrame:
    return points.join(ids.select(*KEY).distinct(), KEY, "left_semi")


def spot_gaps(points: DataFrame, tile: int = TILE) -> DataFrame:
    """Lines over the frames without a fit: lead-in, between two fits, lead-out."""
    fitted = F.col("spot_x").isNotNull() & F.col("spot_y").isNotNull()
    rows = with_position(points, KEY, "frame", tile=tile).withColumn("_fit", fitted)
    fits = nearest(
        rows.where("_fit"),
        KEY,
        "frame",
        prev={"pf": "frame", "pp": "pos", "px": "spot_x", "py": "spot_y"},
        next={"nf": "frame"},
        tile=tile,
    )
    # A fit opens a line to the fit before it, to the first row, or from itself to the last row.
    kinds = F.array_compact(
        F.array(
            F.when(F.col("pos") - F.col("pp") > 1, F.lit("gap")),
            F.when(F.col("pf").isNull() & (F.col("pos") > 0), F.lit("lead_in")),
            F.when(F.col("nf").isNull(), F.lit("lead_out")),
        )
    )
    ends = points.groupBy(*KEY).agg(
        *[F.min_by(c, "frame").alias(f"a_{c}") for c in ("frame", "search_x", "search_y")],
        *[F.max_by(c, "frame").alias(f"z_{c}") for c in ("frame", "search_x", "search_y")],
    )
    lines = fits.withColumn("kind", F.explode(kinds)).join(ends, KEY).where("kind <> 'lead_out' or z_frame > frame")

    def pick(gap: str, lead_in: str, lead_out: str) -> Column:
        kind = F.col("kind")
        return F.when(kind == "gap", F.col(gap)).when(kind == "lead_in", F.col(lead_in)).otherwise(F.col(lead_out))

    return lines.select(
        *KEY,
        "kind",
        pick("pf", "a_frame", "frame").alias("f0"),
        pick("px", "a_search_x", "spot_x").alias("x0"),
        pick("py", "a_search_y", "spot_y").alias("y0"),
        pick("frame", "frame", "z_frame").alias("f1"),
        pick("spot_x", "spot_x", "z_search_x").alias("x1"),
        pick("spot_y", "spot_y", "z_search_y").alias("y1"),
    )


def non_empty_columns(df: DataFrame, keep: Sequence[str] = ()) -> list[str]:
    """Columns with at least one cell that is not blank, plus ``keep``; one pass."""
    row = df.agg(*[_filled(c).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if c in keep or row[c] > 0]


def column_profile(df: DataFrame) -> DataFrame:
    """Filled cells per column as one row."""
    return df.agg(*[_filled(c).alias(c) for c in df.columns])


def _filled(c: str) -> Column:
    return F.count(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")))
