"""Anchors, segments between anchors, and search centres along them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.config import KEY
from trackloom.operators.ordered import TILE, interval_lookup, nearest


def one_per_frame(nodes: DataFrame) -> DataFrame:
    """One node per frame (the smallest x, y), so segments and labels agree."""
    at = F.struct("x", "y")
    return nodes.groupBy(*KEY, "frame").agg(F.min(at).alias("_a")).select(*KEY, "frame", "_a.x", "_a.y")


def dedupe_nodes(nodes: DataFrame, order: str, tile: int = TILE) -> DataFrame:
    """Drop a node that repeats the previous one; ``order`` is unique within a trajectory."""
    cols = [c for c in nodes.columns if c == "frame" or c not in (*KEY, "pos", order)]
    named = {f"_p_{c}": c for c in cols}
    out = nearest(nodes, KEY, order, prev={**named, "_seen": order}, tile=tile)
    same = F.col("_seen").isNotNull()
    for c in cols:
        same = same & F.col(f"_p_{c}").eqNullSafe(F.col(c))
    return out.where(~same).select(*nodes.columns)


def anchor_segments(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """Consecutive nodes as segments; the shared frame belongs to the earlier one."""
    n = nearest(one_per_frame(nodes), KEY, "frame", next={"end_frame": "frame", "x1": "x", "y1": "y"}, tile=tile, pos="pos")
    return n.where("end_frame is not null").select(
        *KEY,
        (F.col("pos") + 1).cast("int").alias("segment"),
        F.when(F.col("pos") == 0, F.col("frame")).otherwise(F.col("frame") + 1).alias("start_frame"),
        "end_frame",
        F.col("frame").alias("anchor_frame"),
        F.col("x").alias("x0"),
        F.col("y").alias("y0"),
        "x1",
        "y1",
    )


def label_segments(points: DataFrame, nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """Segment of each point: 1 before the first node, the last one behind the end.

    NULL without nodes.  A node on the point's own frame closes its segment.
    """
    n = nearest(one_per_frame(nodes).select(*KEY, "frame"), KEY, "frame", next={"_next": "frame"}, tile=tile, pos="_pos")
    # What a node says of the points behind it: the segment it opens, or the last one again.
    behind = F.when(F.col("_next").isNotNull(), F.col("_pos") + 1).otherwise(F.greatest("_pos", F.lit(1)))
    marks = n.select(*KEY, F.col("frame").alias("_at"), behind.cast("int").alias("_segment"))
    rest = [c for c in points.columns if c not in (*KEY, "frame")]
    rows = points.select(*KEY, F.col("frame").alias("_at"), F.struct(F.lit(True).alias("_is"), *rest).alias("_row"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    # A node comes behind the point of its own frame, whose segment it closes.
    both = both.withColumn("_o", F.col("_at") * 2 + F.col("_row").isNull().cast("int"))
    mark = {"prev": {"_behind": "_segment"}, "next": {"_before": "_segment"}}
    found = nearest(both, KEY, "_o", **mark, where=F.col("_segment").isNotNull(), tile=2 * tile).where("_row is not null")
    segment = F.coalesce("_behind", F.when(F.col("_before").isNotNull(), F.lit(1)))
    return found.select(
        *[F.col(c) if c in KEY else F.col("_at").alias(c) if c == "frame" else F.col(f"_row.{c}").alias(c) for c in points.columns],
        segment.alias("segment"),
    )


def in_segment_rows(points: DataFrame, nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """Points inside first node .. last node with their segment; others are left out."""
    return in_segments(points, anchor_segments(nodes, tile=tile))


def in_segments(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Points with the segment that holds their frame."""
    return interval_lookup(points, segments, KEY, "frame", "start_frame", "end_frame", ["segment"]).where("segment is not null")


def densify(nodes: DataFrame, lag_compat: bool = False, tile: int = TILE) -> DataFrame:
    """One search centre per frame, linear between nodes.

    By default each frame gets the point that belongs to it.  ``lag_compat``
    starts every later segment on its node one frame late.
    """
    s = anchor_segments(nodes, tile=tile)
    n = F.col("end_frame") - F.col("start_frame")
    rows = s.withColumn("frame", F.explode(F.sequence("start_frame", "end_frame")))
    if lag_compat:
        t = F.when(n > 0, (F.col("frame") - F.col("start_frame")) / n).otherwise(F.lit(0.0))
    else:
        t = (F.col("frame") - F.col("anchor_frame")) / (F.col("end_frame") - F.col("anchor_frame"))
    return rows.select(
        *KEY,
        "segment",
        "frame",
        (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"),
        (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"),
    )
