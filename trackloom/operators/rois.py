"""Joins and edits between trajectories and line ROIs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.config import KEY
from trackloom.functions import geometry as H
from trackloom.functions import scalars as S
from trackloom.operators.ordered import BLOCK, TILE, nearest, spread, with_position
from trackloom.operators.segments import densify


def roi_table(rois: DataFrame) -> DataFrame:
    """Length, vertex count and kymograph width of each ROI."""
    x, y = F.col("x"), F.col("y")
    return rois.select(
        "movie",
        "roi",
        F.size(x).alias("n_vertices"),
        H.roi_length(x, y).alias("length_px"),
        H.kymo_width(x, y).alias("width"),
    )


def match_geometry(trajectories: DataFrame, rois: DataFrame) -> DataFrame:
    """Trajectories with the ROI of identical geometry (type, x, y)."""

    def keyed(df: DataFrame) -> DataFrame:
        args = F.col("type"), F.col("x"), F.col("y")
        return df.withColumn("_h", H.roi_hash(*args)).withColumn("_k", H.roi_key(*args))

    t = keyed(trajectories).drop("type", "x", "y")
    r = keyed(rois).select("movie", "_h", "_k", "roi")
    return t.join(r, ["movie", "_h", "_k"]).drop("_h", "_k")


def _distance(x: Column, y: Column, px: Column, py: Column) -> Column:
    far = F.aggregate(
        H.segments(x, y),
        F.lit(float("inf")),
        lambda best, v: F.least(best, S.segment_distance(px, py, v.ax, v.ay, v.bx, v.by)),
    )
    return far


def roi_distance(df: DataFrame, px: str, py: str, name: str = "roi_distance") -> DataFrame:
    """Distance from (px, py) to the line x, y on the same row."""
    return df.withColumn(name, _distance(F.col("x"), F.col("y"), F.col(px), F.col(py)))


_ROW_OF_CELLS = 1 << 31


def _cell(cx: Column, cy: Column) -> Column:
    """One number per grid cell."""
    return cx.cast("long") * _ROW_OF_CELLS + cy.cast("long")


def _cells_along(x: Column, y: Column, side: float) -> Column:
    """The grid cells of ``side`` that can hold a point within 0.75 ``side`` of the line x, y."""

    def beside(v: Column) -> Column:
        n = F.ceil(v.len / (side / 2)).cast("int")
        step = F.greatest(n, F.lit(1))
        at = F.transform(
            F.sequence(F.lit(0), n),
            lambda i: _cell(F.floor((v.ax + (v.bx - v.ax) * i / step) / side), F.floor((v.ay + (v.by - v.ay) * i / step) / side)),
        )
        return F.flatten(F.transform(F.array_distinct(at), lambda c: F.transform(around, lambda o: c + o)))

    around = F.array(*[F.lit(i * _ROW_OF_CELLS + j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    known = F.filter(H.segments(x, y), lambda v: v.len.isNotNull())
    return F.array_distinct(F.flatten(F.transform(known, beside)))


def _covered_cells(rois: DataFrame, radius: float, side: float) -> DataFrame:
    """Each ROI segment with the grid cells that can hold a point within ``radius``."""
    segs = spread(rois.select("movie", "roi", "x", "y"), "movie", "roi")
    segs = segs.select("movie", "roi", F.inline(H.segments(F.col("x"), F.col("y"))))
    ends = F.array("ax", "bx"), F.array("ay", "by")
    segs = segs.withColumn("_cell", F.explode(_cells_along(*ends, side)))
    # Of the cells beside the segment those whose middle is near enough (small slack against rounding).
    cy = F.col("_cell") - F.floor(F.col("_cell") / _ROW_OF_CELLS + 0.5) * _ROW_OF_CELLS
    cx = (F.col("_cell") - cy) / _ROW_OF_CELLS
    middle = (cx + 0.5) * side, (cy + 0.5) * side
    off = S.segment_distance(*middle, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return segs.where(off <= (radius + side * 0.5**0.5) * (1 + 1e-6) + 1e-6)


def _divided(
    points: DataFrame, covers: DataFrame, side: float, px: str, py: str, along: str, run: int
) -> tuple[DataFrame, DataFrame]:
    """Points, and rows that carry the ``_cell`` they cover, dealt by ``_cell`` and, within it, ``_run``.

    A spot that rests, or tracks that begin at one place, put any number of points in one cell.  So the
    points of a cell are counted by runs of ``run`` values of ``along``, and runs are put together as long
    as they hold ``run`` points at most.  A covering row is sent once to each of these pieces: their number
    follows the points of its own cell, and most cells are one piece.
    """
    p = points.withColumn("_cell", _cell(F.floor(F.col(px) / side), F.floor(F.col(py) / side)))
    p = p.withColumn("_r", F.coalesce(F.floor(F.col(along) / run), F.lit(-1).cast("bigint")))
    runs = p.groupBy("movie", "_cell", "_r").agg(F.count(F.lit(1)).alias("_n"))
    # A run of more than half a piece is a piece of its own; the others fill up halves.
    large, half = F.col("_n") > run / 2, max(run // 2, 1)
    before = W.partitionBy("movie", "_cell").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    small = F.coalesce(F.sum(F.when(large, 0).otherwise(F.col("_n"))).over(before), F.lit(0))
    runs = runs.select("movie", "_cell", "_r", F.when(large, F.col("_r") * 2 + 1).otherwise(F.floor(small / half) * 2).alias("_run"))
    later = runs.where("_run <> 0")
    p = p.join(later, ["movie", "_cell", "_r"], "left").select(*points.columns, "_cell", F.coalesce("_run", F.lit(0)).cast("bigint").alias("_run"))
    pieces = runs.select("movie", "_cell", "_run").distinct()
    # The rows of ``covers`` were multiplied, which their estimated size does not tell: never broadcast them.
    return p, covers.hint("merge").join(pieces.hint("merge"), ["movie", "_cell"]).hint("merge")


def _same(p: str, q: str) -> Column:
    cond = F.lit(True)
    for c in ("movie", "_cell", "_run"):
        cond = cond & (F.col(f"{p}.{c}") == F.col(f"{q}.{c}"))
    return cond


def _close(
    points: DataFrame, rois: DataFrame, radius: float, px: str, py: str, along: str, run: int
) -> tuple[DataFrame, DataFrame, Column]:
    """Points and segments that share a cell and, within it, a piece of ``along``."""
    # Existence only: wide cells make few copies of a segment, and a search ends at the first hit.
    side = 4 * radius
    p, q = _divided(points, _covered_cells(rois, radius, side), side, px, py, along, run)
    p, q = p.alias("p"), q.alias("q")
    d = S.segment_distance(
        F.col(f"p.{px}"), F.col(f"p.{py}"), F.col("q.ax"), F.col("q.ay"), F.col("q.bx"), F.col("q.by")
    )
    return p, q, (d <= radius) & _same("p", "q")


def near_roi(
    points: DataFrame, rois: DataFrame, radius: float, px: str = "x", py: str = "y", along: str = "frame", run: int = BLOCK
) -> DataFrame:
    """Points within ``radius`` of any ROI of their movie; a cell is divided by ``along``."""
    p, q, cond = _close(points, rois, radius, px, py, along, run)
    return p.join(q, cond, "left_semi").drop("_cell", "_run")


def match_by_place(ends: DataFrame, rois: DataFrame, radius: float, run: int = BLOCK) -> DataFrame:
    """(trajectory, ROI) where start and end both lie within ``radius`` of the line; a cell is divided by trajectory.

    ``ends`` has start_x, start_y, end_x, end_y per trajectory.  A ROI goes to the cells of its line with
    its whole geometry, and a start lies in one cell, so a pair meets once and both ends are judged where
    it meets: only matches leave the join.  Records of one ROI id are one ROI, and each whose line the end
    is near is a match.
    """
    side = 1.34 * radius
    line = F.struct("x", "y")
    r = rois.where("movie is not null and roi is not null").groupBy("movie", "roi").agg(F.collect_list(line).alias("_lines"))
    # Most pairs of a cell end at the box around the ROI (small slack against rounding).
    reach, box = radius + 1e-6, {}
    for c in "xy":
        box[f"_{c}0"] = F.array_min(F.transform("_lines", lambda v: F.array_min(v[c]))) - reach
        box[f"_{c}1"] = F.array_max(F.transform("_lines", lambda v: F.array_max(v[c]))) + reach
    cells = F.array_distinct(F.flatten(F.filter(F.transform("_lines", lambda v: _cells_along(v.x, v.y, side)), lambda c: c.isNotNull())))
    covers = spread(r, "movie", "roi").withColumns(box).withColumn("_cell", F.explode(cells))
    p, q = _divided(ends.distinct(), covers, side, "start_x", "start_y", "trajectory", run)
    p, q = p.alias("p"), q.alias("q")
    cond = _same("p", "q")
    for c in ("start_x", "start_y", "end_x", "end_y"):
        cond = cond & F.col(f"p.{c}").between(F.col(f"q._{c[-1]}0"), F.col(f"q._{c[-1]}1"))

    def near(end: str) -> Callable[[Column], Column]:
        return lambda v: _distance(v.x, v.y, F.col(f"p.{end}_x"), F.col(f"p.{end}_y")) <= radius

    cond = cond & F.exists("q._lines", near("start")) & F.exists("q._lines", near("end"))
    met = p.join(q, cond).withColumn("_line", F.explode("q._lines")).where(near("end")(F.col("_line")))
    return met.select(F.col("p.movie"), F.col("q.roi"), *[F.col(f"p.{c}") for c in ends.columns if c != "movie"])


def empty_rois(rois: DataFrame, used: DataFrame) -> DataFrame:
    return rois.select("movie", "roi").join(used.select("movie", "roi").distinct(), ["movie", "roi"], "left_anti")


def distinct_rois(df: DataFrame, order: str) -> DataFrame:
    """Distinct geometries with the order value at which each was first seen."""
    return df.groupBy("movie", "type", "x", "y").agg(F.min(order).alias("first_seen"))


def invert_rois(rois: DataFrame, ids: DataFrame) -> DataFrame:
    """Reverse the direction of the chosen ROIs."""
    chosen = ids.select("movie", "roi").distinct().withColumn("_flip", F.lit(True))
    out = rois.join(chosen, ["movie", "roi"], "left")
    for c in ("x", "y"):
        out = out.withColumn(c, F.when(F.col("_flip"), F.reverse(c)).otherwise(F.col(c)))
    return out.drop("_flip")


def invert_anchors(anchors: DataFrame, rois: DataFrame, ids: DataFrame) -> DataFrame:
    """Mirror kymograph anchors of trajectories on the chosen ROIs: xk becomes width-1-xk."""
    chosen = rois.join(ids.select("movie", "roi").distinct(), ["movie", "roi"], "left_semi").select(
        "movie", "roi", H.kymo_width(F.col("x"), F.col("y")).alias("_w")
    )
    out = anchors.join(chosen, ["movie", "roi"], "left")
    return out.withColumn("xk", F.when(F.col("_w").isNotNull(), F.col("_w") - 1 - F.col("xk")).otherwise(F.col("xk"))).drop("_w")


def invert_kymograph(kymo: DataFrame, ids: DataFrame, widths: DataFrame) -> DataFrame:
    """Mirror the samples of the chosen ROIs."""
    chosen = widths.join(ids.select("movie", "roi").distinct(), ["movie", "roi"], "left_semi").select(
        "movie", "roi", F.col("width").alias("_w")
    )
    out = kymo.join(chosen, ["movie", "roi"], "left")
    return out.withColumn("s", F.coalesce(F.col("_w") - 1 - F.col("s"), F.col("s"))).drop("_w")


def kymo_endpoints(points: DataFrame, rois: DataFrame) -> DataFrame:
    """First and last point of each trajectory as kymograph column and frame."""
    ends = points.groupBy(*KEY, "roi").agg(
        *[fn(c, "frame").alias(f"{n}_{c}") for fn, n in ((F.min_by, "start"), (F.max_by, "end")) for c in ("frame", "px", "py")]
    )
    out = ends.join(H.lines(rois), ["movie", "roi"])
    return out.select(
        *KEY,
        "roi",
        "start_frame",
        H.roi_project(F.col("start_px"), F.col("start_py")).alias("start_xk"),
        "end_frame",
        H.roi_project(F.col("end_px"), F.col("end_py")).alias("end_xk"),
    )


def project_points(points: DataFrame, rois: DataFrame, px: str, py: str) -> DataFrame:
    """Kymograph column ``xk`` of points that carry ``roi``."""
    out = points.join(H.lines(rois), ["movie", "roi"])
    return out.select(*points.columns, H.roi_project(F.col(px), F.col(py)).alias("xk"))


def anchors_to_nodes(anchors: DataFrame, rois: DataFrame) -> DataFrame:
    """Movie position of kymograph anchors that carry ``roi`` and ``xk``."""
    kept = [c for c in anchors.columns if c not in ("x", "y")]
    out = anchors.join(H.lines(rois), ["movie", "roi"]).select(*kept, H.roi_point(F.col("xk")).alias("_p"))
    return out.select(*kept, F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def backfill_nodes(nodes: DataFrame, anchors: DataFrame, rois: DataFrame) -> DataFrame:
    """Nodes, and for trajectories without any, nodes made from their anchors."""
    lacking = anchors.join(nodes.select(*KEY).distinct(), KEY, "left_anti")
    made = anchors_to_nodes(lacking, rois)
    return nodes.select(*KEY, "frame", "x", "y").unionByName(made.select(*KEY, "frame", "x", "y"))


def densify_kymo(anchors: DataFrame, rois: DataFrame, lag_compat: bool = False, tile: int = TILE) -> DataFrame:
    """One search centre per frame: linear along the kymograph, then onto the line."""
    lines = anchors.select(*KEY, "frame", F.col("xk").alias("x"), F.lit(0.0).alias("y"))
    per_frame = densify(lines, lag_compat, tile).drop("y").withColumnRenamed("x", "xk")
    roi_of = anchors.groupBy(*KEY).agg(F.min("roi").alias("roi"))
    return anchors_to_nodes(per_frame.join(roi_of, KEY), rois)


def pairs_to_trajectories(points: DataFrame, rois: DataFrame, tile: int = TILE) -> DataFrame:
    """Consecutive points (movie, roi, idx, xk, y) as start and end of trajectories."""
    n = with_position(points, ["movie", "roi"], "idx", tile=tile)
    n = n.select(
        "movie",
        "roi",
        (F.floor(F.col("pos") / 2) + 1).alias("trajectory"),
        F.when(F.col("pos") % 2 == 0, "start").otherwise("end").alias("side"),
        F.bround("y").cast("int").alias("frame"),
        "xk",
    )
    return anchors_to_nodes(n, rois)


def validate_anchors(anchors: DataFrame, rois: DataFrame, movies: DataFrame, tile: int = TILE) -> DataFrame:
    """Status per trajectory: ok, Out of bounds, or Bad anchor order.

    Anchors carry roi, i (their order), frame, xk and yk.
    """
    a = nearest(anchors, KEY, "i", prev={"_before": "frame"}, tile=tile)
    a = a.join(roi_table(rois).select("movie", "roi", "width"), ["movie", "roi"]).join(
        movies.select("movie", "n_frames"), "movie"
    )
    top = F.col("n_frames") - 1
    inside = F.col("frame").between(0, top) & F.col("xk").between(0, F.col("width")) & F.col("yk").between(0, top)
    per = a.groupBy(*KEY).agg(
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("_out"),
        F.count_if(F.col("frame") <= F.col("_before")).alias("_back"),
    )
    return per.select(
        *KEY,
        F.when(F.col("_out") > 0, "Out of bounds").when(F.col("_back") > 0, "Bad anchor order").otherwise("ok").alias("status"),
    )


def kymo_registry(rois: DataFrame, movies: DataFrame) -> DataFrame:
    """One kymograph name per ROI and channel."""
    out = rois.select("movie", "roi").join(movies.select("movie", "n_channels"), "movie")
    return out.select(
        "movie",
        "roi",
        F.explode(F.sequence(F.lit(1), "n_channels")).alias("channel"),
        F.lit(False).alias("orphaned"),
    ).withColumn("kymograph", F.format_string("ch%d-%03d", "channel", "roi"))


def registry_for_channel(registry: DataFrame, channel: int) -> DataFrame:
    return registry.where((F.col("channel") == channel) & ~F.col("orphaned"))


def next_roi_name(rois: DataFrame) -> DataFrame:
    return rois.groupBy("movie").agg(F.format_string("%03d", F.coalesce(F.max("roi"), F.lit(0)) + 1).alias("next_name"))


def delete_kymographs(registry: DataFrame, rois: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry without the named kymographs, and ROIs that an entry still uses."""
    left = registry.join(names.select("movie", "kymograph").distinct(), ["movie", "kymograph"], "left_anti")
    kept = rois.join(left.select("movie", "roi").distinct(), ["movie", "roi"], "left_semi")
    return left, kept
