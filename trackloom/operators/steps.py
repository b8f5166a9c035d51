"""Intensity steps: smoothing, edges, levels between edges."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.config import KEY
from trackloom.functions.smooth import edge_smooth as _smooth
from trackloom.operators.ordered import BLOCK, TILE, beside, in_blocks, interval_lookup, nearest, with_position
from trackloom.operators.quantiles import exact_percentiles


def edge_smooth(
    points: DataFrame,
    half: int = 15,
    passes: int = 10,
    zero_compat: bool = False,
    group: Sequence[str] = KEY,
    tile: int = TILE,
    block: int = BLOCK,
) -> DataFrame:
    """Smoothed intensity and its pseudo-derivative for every known intensity.

    A value depends on at most half * (passes + 1) neighbours on each side, so
    blocks with that many copied rows give the same result as the whole trace.
    Arrays hold one block each, never a whole trace.
    """
    group = list(group)
    halo = half * (passes + 1)

    @F.pandas_udf("smooth array<double>, slope array<double>")
    def run(traces: pd.Series) -> pd.DataFrame:
        done = [_smooth(t, half, passes, zero_compat) for t in traces]
        return pd.DataFrame({"smooth": [d[0] for d in done], "slope": [d[1] for d in done]})

    known = points.where("intensity is not null").select(*group, "frame", "intensity")
    rows = in_blocks(with_position(known, group, "frame", tile=tile), before=halo, after=halo, size=block)
    packed = rows.groupBy(*group, "_block").agg(
        F.sort_array(F.collect_list(F.struct("pos", "frame", "intensity", "_ghost"))).alias("_t")
    )
    out = packed.where(F.exists("_t", lambda t: ~t["_ghost"])).withColumn("_s", run(F.col("_t.intensity")))
    return (
        out.select(*group, F.inline(F.arrays_zip("_t", F.col("_s.smooth").alias("smooth"), F.col("_s.slope").alias("slope"))))
        .where(~F.col("_t._ghost"))
        .select(*group, F.col("_t.pos").alias("pos"), F.col("_t.frame").alias("frame"), "smooth", "slope")
    )


def _edges(smoothed: DataFrame, min_step: float, group: list[str]) -> DataFrame:
    near = beside(smoothed, group, prev={"_before": "slope"}, next={"_after": "slope"})
    rise = F.signum(F.col("_after") - F.col("slope"))
    fall = F.signum(F.col("slope") - F.col("_before"))
    turn = (
        F.when(F.col("_before").isNull(), rise != 0)
        .when(F.col("_after").isNull(), fall != 0)
        .otherwise(rise != fall)
    )
    is_edge: Column = F.coalesce(turn, F.lit(False)) & (F.abs("slope") > min_step) & F.col("_before").isNotNull()
    return near.withColumn("is_edge", is_edge)


def step_edges(smoothed: DataFrame, min_step: float = 100.0, group: Sequence[str] = KEY) -> DataFrame:
    """Frames where the slope has an extremum above ``min_step``; never the first frame."""
    return _edges(smoothed, min_step, list(group)).where("is_edge").select(*group, "frame", "slope")


def steps(
    smoothed: DataFrame,
    min_step: float = 100.0,
    group: Sequence[str] = KEY,
    tile: int = TILE,
) -> DataFrame:
    """Levels between edges (both ends included) with the median smoothed value.

    ``smoothed`` is read several times: pass a stored result of ``edge_smooth``.
    """
    group = list(group)
    s = _edges(smoothed, min_step, group)
    cuts = s.where("is_edge or _before is null or _after is null")
    cuts = with_position(cuts.select(*group, "frame"), group, "frame", name="step", tile=tile)
    cuts = beside(cuts, group, next={"end_frame": "frame"}, pos="step").where("end_frame is not null")
    cuts = cuts.select(*group, "step", F.col("frame").alias("start_frame"), "end_frame")
    # The frame of a cut belongs to the level before it, too; there the interval that starts is the one looked up.
    rows = interval_lookup(smoothed.select(*group, "frame", "smooth"), cuts, group, "frame", "start_frame", "end_frame", ["step", "start_frame"], tile)
    both = F.when((F.col("frame") == F.col("start_frame")) & (F.col("step") > 0), F.array("step", F.col("step") - 1))
    rows = rows.where("step is not null").select(*group, F.explode(F.coalesce(both, F.array("step"))).alias("step"), "smooth")
    level = exact_percentiles(rows, [*group, "step"], "smooth", {"level": 0.5})
    return cuts.join(level, [*group, "step"]).withColumn("step", F.col("step").cast("int"))


def step_summary(steps_df: DataFrame, backgrounds: DataFrame, group: Sequence[str] = KEY, tile: int = TILE) -> DataFrame:
    """Number of steps and mean step height, also with the last drop to the background."""
    group = list(group)
    s = nearest(steps_df, group, "step", prev={"_before": "level"}, tile=tile)
    per = s.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.sum(F.abs(F.col("level") - F.col("_before"))).alias("_sum"),
        F.count("_before").alias("_n"),
        F.max_by("level", "step").alias("_last"),
    )
    out = per.join(backgrounds.select(*KEY, "fixed_background"), KEY, "left")
    mean = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))
    drop = F.abs(F.col("_last") - F.col("fixed_background"))
    with_bg = F.when(F.col("_n") > 0, F.coalesce((F.col("_sum") + drop) / (F.col("_n") + 1), mean))
    return out.select(*group, "n_steps", mean.alias("mean_step"), with_bg.alias("mean_step_background"))


def label_steps(points: DataFrame, steps_df: DataFrame) -> DataFrame:
    """First step whose closed interval holds the frame, with its level."""
    # A shared frame belongs to the earlier step, so later steps start one frame on.
    marks = steps_df.select(
        *KEY,
        "step",
        "level",
        F.when(F.col("step") == 0, F.col("start_frame")).otherwise(F.col("start_frame") + 1).alias("_from"),
        F.col("end_frame").alias("_to"),
    )
    return interval_lookup(points, marks, KEY, "frame", "_from", "_to", ["step", "level"])


def steps_from_points(points: DataFrame) -> DataFrame:
    """Step table of points that already carry step and level."""
    return (
        points.where("step is not null")
        .groupBy(*KEY, "step")
        .agg(
            F.min("frame").alias("start_frame"),
            F.max("frame").alias("end_frame"),
            F.min_by("level", "frame").alias("level"),
        )
    )
