"""Drift of a movie from one reference spot path with missing frames.

A missing frame moves by the last displacement.  After k misses the next
displacement is d = fit - (last fit + k * last d), a linear recurrence.  Blocks
of it compose like affine maps, so a long path is solved block by block and
only the block totals are scanned in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.folds import running
from trackloom.operators.ordered import BLOCK, TILE, beside, nearest, with_position
from trackloom.plans.stages import stage


_MOST = 1e300


def _through(d: Column, fit: Column) -> Column:
    """The displacement after one more fit, as a + b * (displacement before the block)."""
    m = -fit.k
    # A finite bound keeps a path at rest at rest: 0 times infinity is no number.
    b = F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), m * d.b))
    return F.struct(
        (fit.gx + m * d.ax).alias("ax"), (fit.gy + m * d.ay).alias("ay"), F.when(fit.k != 0, b).otherwise(F.lit(0.0)).alias("b")
    )


def _past(p: Column, block: Column) -> Column:
    """The displacement after a block whose map is known."""
    moved = block.b != 0
    return F.struct(
        F.when(moved, block.ax + block.b * p.x).otherwise(block.ax).alias("x"),
        F.when(moved, block.ay + block.b * p.y).otherwise(block.ay).alias("y"),
    )


def _displacements(fits: DataFrame, key: list[str], block: int) -> DataFrame:
    """(key, frame, x, y, ddx, ddy) of fitted rows with step gx, gy and misses k before them."""
    rows = fits.withColumn("_block", F.floor(F.col("pos") / block))
    rest = F.struct(F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(1.0).alias("b"))
    packed = (
        rows.groupBy(*key, "_block")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "frame", "x", "y", "gx", "gy", "k"))).alias("_r"))
        .withColumn("_m", running(F.col("_r"), rest, _through))
        .withColumn("_m", F.slice("_m", 2, F.size("_r")))
    )
    packed = stage(packed, "drift-blocks")
    # Totals of the blocks, in order: at most one row per 4,096 fits.
    totals = packed.select(*key, "_block", *[F.element_at(F.col(f"_m.{c}"), -1).alias(c) for c in ("ax", "ay", "b")])
    chained = totals.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_block", "ax", "ay", "b"))).alias("_t"))

    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    before = chained.withColumn("_s", F.slice(running(F.col("_t"), start, _past), 1, F.size("_t"))).select(
        *key, F.inline(F.arrays_zip(F.col("_t._block").alias("_block"), F.col("_s.x").alias("_dx"), F.col("_s.y").alias("_dy")))
    )
    flat = packed.join(before, [*key, "_block"]).select(
        *key,
        "_dx",
        "_dy",
        F.inline(F.arrays_zip(F.col("_r"), F.col("_m.ax").alias("ax"), F.col("_m.ay").alias("ay"), F.col("_m.b").alias("b"))),
    )
    return flat.select(
        *key,
        F.col("_r.frame").alias("frame"),
        F.col("_r.x").alias("x"),
        F.col("_r.y").alias("y"),
        (F.col("ax") + F.col("b") * F.col("_dx")).alias("ddx"),
        (F.col("ay") + F.col("b") * F.col("_dy")).alias("ddy"),
    )


def drift_offsets(
    track: DataFrame, ref_frame: int, key: Sequence[str] = ("movie",), tile: int = TILE, block: int = BLOCK
) -> DataFrame:
    """Offsets (dx, dy) of every frame from the reference position.

    ``track`` has one row per frame (key, frame, x, y), x and y NULL where the
    fit failed; it runs forward and backward from ``ref_frame``, which has a fit.
    """
    key = list(key)
    side = [*key, "_side"]
    away = F.col("frame") - F.lit(ref_frame)
    # Backward frames are a second forward path; the reference starts both.
    rows = track.withColumn("_side", F.explode(F.when(away == 0, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.signum(away).cast("int")))))
    rows = stage(rows.withColumn("_n", F.abs(away)), "drift")
    ordered = with_position(rows, side, "_n", name="idx", tile=tile)
    fits = with_position(ordered.where("x is not null and y is not null"), side, "_n", tile=tile)
    fits = beside(fits, side, prev={"_px": "x", "_py": "y", "_pi": "idx"}, size=block)
    first = F.col("_pi").isNull()
    fits = (
        fits.withColumn("gx", F.when(first, F.lit(0.0)).otherwise(F.col("x") - F.col("_px")))
        .withColumn("gy", F.when(first, F.lit(0.0)).otherwise(F.col("y") - F.col("_py")))
        .withColumn("k", F.when(first, F.lit(0)).otherwise(F.col("idx") - F.col("_pi") - 1).cast("double"))
    )
    moves = _displacements(fits, side, block)
    known = ordered.select(*side, "frame", "_n", "idx").join(
        moves.select(*side, "frame", "x", "y", "ddx", "ddy"), [*side, "frame"], "left"
    )
    known = stage(known, "drift-fits")
    last = nearest(
        known,
        side,
        "_n",
        prev={"_lx": "x", "_ly": "y", "_ldx": "ddx", "_ldy": "ddy", "_li": "idx"},
        where=F.col("x").isNotNull(),
        tile=tile,
    )
    k = F.col("idx") - F.col("_li")
    out = last.select(
        *side,
        "frame",
        F.when(F.col("x").isNotNull(), F.col("x")).otherwise(F.col("_lx") + k * F.col("_ldx")).alias("_x"),
        F.when(F.col("x").isNotNull(), F.col("y")).otherwise(F.col("_ly") + k * F.col("_ldy")).alias("_y"),
    ).where(~((F.col("frame") == ref_frame) & (F.col("_side") == -1)))
    start = track.where(F.col("frame") == ref_frame).select(*key, F.col("x").alias("_rx"), F.col("y").alias("_ry"))
    return out.join(start, key).select(
        *key, "frame", (F.col("_x") - F.col("_rx")).alias("dx"), (F.col("_y") - F.col("_ry")).alias("dy")
    )
