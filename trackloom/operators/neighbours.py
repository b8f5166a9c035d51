"""Existence of a near neighbour, as a cell-bucketed semi join.

Cells have side 2.5 r, so a place is copied to the one to four cells that its
circle touches (2.9 on average).  The semi join stops at the first hit, so no
pairs are produced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIDE = 2.5


def _cell(c: Column, r: float) -> Column:
    return F.floor(c / F.lit(_SIDE * r))


def near_any(
    places: DataFrame,
    others: DataFrame,
    on: Sequence[str],
    r: float,
    row_id: Sequence[str],
    inclusive: bool = True,
    extra: Column | None = None,
    xy: tuple[str, str] = ("x", "y"),
) -> DataFrame:
    """Ids of the ``places`` that have one of ``others`` within ``r``.

    Both frames carry x and y (``xy``) and the ``on`` columns.  ``extra`` is a further
    condition over aliases ``p`` and ``o``.
    """
    side = _SIDE * r
    px, py = F.col(xy[0]), F.col(xy[1])

    def cells(c: Column) -> Column:
        return F.explode(F.sequence(_cell(c - r, r), _cell(c + r, r)))

    grid = places.where(px.isNotNull() & py.isNotNull()).withColumn("_cx", cells(px)).withColumn("_cy", cells(py))

    def gap(c: Column, cell: Column) -> Column:
        return F.greatest(F.lit(0.0), cell * side - c, c - (cell + 1) * side)

    gx, gy = gap(px, F.col("_cx")), gap(py, F.col("_cy"))
    # Drop cells that the circle does not reach (small slack against rounding).
    grid = grid.where(gx * gx + gy * gy <= (r * r) * (1 + 1e-9)).alias("p")
    targets = (
        others.where(px.isNotNull() & py.isNotNull())
        .withColumn("_cx", _cell(px, r))
        .withColumn("_cy", _cell(py, r))
        .alias("o")
    )
    dx = F.col(f"p.{xy[0]}") - F.col(f"o.{xy[0]}")
    dy = F.col(f"p.{xy[1]}") - F.col(f"o.{xy[1]}")
    d2 = dx * dx + dy * dy
    hit = d2 <= r * r if inclusive else d2 < r * r
    cond = hit if extra is None else hit & extra
    for c in [*on, "_cx", "_cy"]:
        cond = cond & (F.col(f"p.{c}") == F.col(f"o.{c}"))
    return grid.join(targets, cond, "left_semi").select(*[F.col(f"p.{c}") for c in row_id]).distinct()
