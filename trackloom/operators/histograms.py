"""Speed histograms with automatic bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.config import KEY
from trackloom.operators.quantiles import exact_percentiles


def speed_histogram(
    speeds: DataFrame, movies: DataFrame, group: Sequence[str] = KEY
) -> DataFrame:
    """Counts per bin of the speeds (µm/s with scale, else px/frame), with the mean.

    The bin width is the smaller one of Sturges' rule and Freedman-Diaconis'
    rule; without a spread between the quartiles it is Sturges'.
    """
    group = list(group)
    scale = movies.select("movie", "pixel_size_nm", "frame_interval_ms")
    rows = (
        speeds.where("speed is not null")
        .join(scale, "movie", "left")
        .withColumn("_v", F.col("speed") * F.coalesce(F.col("pixel_size_nm") / F.col("frame_interval_ms"), F.lit(1.0)))
        .select(*group, "_v")
    )
    stats = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_z"), F.avg("_v").alias("mean_speed")
    )
    q = exact_percentiles(rows, group, "_v", {"_q1": 0.25, "_q3": 0.75})
    spread = F.col("_z") - F.col("_a")
    sturges = spread / (F.log2("_n") + 1)
    fd = 2 * (F.col("_q3") - F.col("_q1")) / F.pow("_n", F.lit(1 / 3))
    width = F.when(fd > 0, F.least(sturges, fd)).otherwise(sturges)
    s = stats.join(q, group).withColumn("bins", F.when(width > 0, F.ceil(spread / width)).otherwise(F.lit(1)).cast("int"))
    s = s.withColumn("low", F.when(spread > 0, F.col("_a")).otherwise(F.col("_a") - 0.5)).withColumn(
        "high", F.when(spread > 0, F.col("_z")).otherwise(F.col("_z") + 0.5)
    )
    s = s.select(*group, "bins", "low", "high", "mean_speed")
    at = F.least(F.floor((F.col("_v") - F.col("low")) * F.col("bins") / (F.col("high") - F.col("low"))), F.col("bins") - 1)
    return rows.join(s, group).groupBy(*group, "bins", "low", "high", "mean_speed", at.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("points")
    )
