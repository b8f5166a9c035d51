"""Ordered-sequence building blocks that stay parallel inside one long key.

A window over a whole key puts that key in one task.  Here every key is cut
into tiles of the ordering column, windows run per (key, tile), and only the
tile edges are joined across.  With a 32-bit frame as ordering column and
65,536 frames per tile, neither a tile nor the list of tiles of a key can
exceed 65,536 rows.  The ordering column must be numeric and unique per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.plans.stages import stage

TILE = 65536
BLOCK = 4096

_UNB = W.unboundedPreceding


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash rows over all shuffle partitions before a step that multiplies them.

    The number is given explicitly, so that a small input is not put back into
    few partitions just before it grows.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def _tiled(df: DataFrame, order: str, tile: int) -> DataFrame:
    return df.withColumn("_tile", F.floor(F.col(order) / F.lit(tile)))


def with_position(
    df: DataFrame, key: Sequence[str], order: str, name: str = "pos", tile: int = TILE
) -> DataFrame:
    """Add the 0-based ordinal of each row within its key."""
    key = list(key)
    tiled = _tiled(df, order, tile)
    local = F.row_number().over(W.partitionBy(*key, "_tile").orderBy(order)).cast("long")
    before = F.sum("_n").over(W.partitionBy(*key).orderBy("_tile").rowsBetween(_UNB, -1))
    starts = (
        tiled.groupBy(*key, "_tile")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*key, "_tile", before.alias("_start"))
        .where("_start is not null")
    )
    return (
        tiled.select("*", local.alias("_local"))
        .join(starts, [*key, "_tile"], "left")
        .select(
            *[F.col(c) for c in df.columns],
            (F.col("_local") - 1 + F.coalesce("_start", F.lit(0))).alias(name),
        )
    )


def nearest(
    df: DataFrame,
    key: Sequence[str],
    order: str,
    prev: Mapping[str, str] | None = None,
    next: Mapping[str, str] | None = None,
    where: Column | None = None,
    tile: int = TILE,
    pos: str | None = None,
) -> DataFrame:
    """Add columns of the nearest earlier / later row (that satisfies ``where``), and the row's position.

    ``prev`` and ``next`` map new column names to source columns; ``pos`` names the 0-based ordinal of each
    row within its key.  All come from one pass: a tile hands on its count, first and last row together.
    """
    key, prev, next = list(key), dict(prev or {}), dict(next or {})
    tiled = _tiled(df, order, tile)
    by_tile = W.partitionBy(*key, "_tile")

    def pack(cols: Mapping[str, str]) -> Column:
        return F.struct(*[F.col(src).alias(name) for name, src in cols.items()])

    sides = [(side, cols) for side, cols in (("p", prev), ("n", next)) if cols]
    locals_, aggs, far = {}, [], {}
    mark = F.col(order) if where is None else F.when(where, F.col(order))
    for side, cols in sides:
        back = side == "p"
        if where is None:
            local = (F.lag if back else F.lead)(pack(cols)).over(by_tile.orderBy(order))
        else:
            win = by_tile.orderBy(F.col(order).asc() if back else F.col(order).desc())
            local = F.last(F.when(where, pack(cols)), True).over(win.rowsBetween(_UNB, -1))
        locals_[f"_{side}_local"] = local
        aggs.append((F.max if back else F.min)(mark).alias(f"_{side}_at"))
        aggs += [(F.max_by if back else F.min_by)(F.col(c), mark).alias(f"_{side}_{name}") for name, c in cols.items()]
        packed = F.struct(*[F.col(f"_{side}_{name}").alias(name) for name in cols])
        tiles = W.partitionBy(*key).orderBy(F.col("_tile").asc() if back else F.col("_tile").desc())
        far[f"_{side}_far"] = F.last(F.when(F.col(f"_{side}_at").isNotNull(), packed), True).over(tiles.rowsBetween(_UNB, -1))
    if pos:
        locals_["_row"] = F.row_number().over(by_tile.orderBy(order)).cast("long")
        aggs.append(F.count(F.lit(1)).alias("_n"))
        far["_start"] = F.sum("_n").over(W.partitionBy(*key).orderBy("_tile").rowsBetween(_UNB, -1))

    # One row per (key, tile): what the tile hands to the tiles after and before it.
    edges = tiled.groupBy(*key, "_tile").agg(*aggs).select(*key, "_tile", *[c.alias(n) for n, c in far.items()])
    edges = edges.where(" or ".join(f"{n} is not null" for n in far))
    out = tiled.select("*", *[c.alias(n) for n, c in locals_.items()]).join(edges, [*key, "_tile"], "left")
    # The packed neighbour gets its own step, so that it is worked out once per row.
    place = [(F.col("_row") - 1 + F.coalesce("_start", F.lit(0))).alias(pos)] if pos else []
    out = out.select(*df.columns, *place, *[F.coalesce(f"_{side}_local", f"_{side}_far").alias(f"_{side}") for side, _ in sides])
    return out.select(*df.columns, *([pos] if pos else []), *[F.col(f"_{side}.{name}").alias(name) for side, cols in sides for name in cols])


def in_blocks(
    df: DataFrame, pos: str = "pos", before: int = 0, after: int = 0, size: int = BLOCK
) -> DataFrame:
    """Cut a positioned sequence into blocks and copy the rows next to each cut.

    Adds ``_block`` and ``_ghost``.  A window over (key, _block) then sees up to
    ``before`` rows before and ``after`` rows behind every non-ghost row.
    """
    size = max(size, before, after)
    rest = F.col(pos) % size
    home = F.floor(F.col(pos) / F.lit(size))
    moves = F.array_compact(
        F.array(
            F.lit(0),
            F.when((rest < after) & (home > 0), F.lit(-1)),
            F.when(rest >= size - before, F.lit(1)),
        )
    )
    return df.select("*", F.explode(moves).alias("_move")).select(
        *df.columns, (home + F.col("_move")).alias("_block"), (F.col("_move") != 0).alias("_ghost")
    )


def beside(
    df: DataFrame,
    key: Sequence[str],
    prev: Mapping[str, str] | None = None,
    next: Mapping[str, str] | None = None,
    pos: str = "pos",
    size: int = BLOCK,
) -> DataFrame:
    """Columns of the row directly before / after, for rows that know their position."""
    prev, next = dict(prev or {}), dict(next or {})
    rows = in_blocks(df, pos, before=1, after=1, size=size)
    w = W.partitionBy(*key, "_block").orderBy(pos)
    found = [step(src).over(w).alias(name) for step, cols in ((F.lag, prev), (F.lead, next)) for name, src in cols.items()]
    return rows.select("*", *found).where(~F.col("_ghost")).select(*df.columns, *prev, *next)


def _dyadic(intervals: DataFrame, low: str, high: str, bucket: int) -> DataFrame:
    """Intervals as aligned blocks of buckets: ``_b`` is the block's number in level ``_l`` (2 ** l buckets).

    At most two blocks of each level, so an interval of n buckets has at most 2 * log2(n) + 2 rows.
    """
    a, z = F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket) + 1

    def level(n: Column) -> Column:
        # Division by a power of two is exact.
        size = F.pow(F.lit(2.0), n)
        first, last = F.ceil(a / size), F.floor(z / size)
        left = F.when((F.pmod(first, F.lit(2)) == 1) & (first < last), F.struct(n.alias("_l"), first.alias("_b")))
        right = F.when((F.pmod(last, F.lit(2)) == 1) & (first < last), F.struct(n.alias("_l"), (last - 1).alias("_b")))
        # The two are one block where the interval has one block of this level only.
        return F.array_distinct(F.array_compact(F.array(left, right)))

    levels = F.sequence(F.lit(0), F.length(F.bin(z - a)) - 1)
    blocks = intervals.where(F.col(high) >= F.col(low)).withColumn("_d", F.explode(F.flatten(F.transform(levels, level))))
    return blocks.select(*intervals.columns, F.col("_d._l").alias("_l"), F.col("_d._b").alias("_b"))


def interval_join(
    rows: DataFrame,
    intervals: DataFrame,
    key: Sequence[str],
    at: str,
    low: str,
    high: str,
    how: str = "inner",
    bucket: int = 64,
) -> DataFrame:
    """Rows with the intervals (both ends included) of their key that hold ``at``; intervals may overlap.

    An interval lies in a few aligned blocks whose sizes are powers of two, and a row is looked up in its
    block of each size that occurs, so neither a long interval nor a long key gathers rows.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how: {how}")
    blocks = _dyadic(intervals, low, high, bucket)
    # The sizes that occur (some forty at most), as one value of the plan.
    sizes = blocks.agg(F.collect_set("_l").alias("l")).scalar()
    r = rows.withColumn("_l", F.explode(sizes))
    r = r.withColumn("_b", F.floor(F.floor(F.col(at) / bucket) / F.pow(F.lit(2.0), F.col("_l")))).alias("r")
    i = blocks.alias("i")
    cond = F.col(f"r.{at}").between(F.col(f"i.{low}"), F.col(f"i.{high}"))
    for c in [*key, "_l", "_b"]:
        cond = cond & (F.col(f"r.{c}") == F.col(f"i.{c}"))
    extra = [c for c in intervals.columns if c not in rows.columns]
    out = r.join(i, cond).select(*[F.col(f"r.{c}") for c in rows.columns], *[F.col(f"i.{c}") for c in extra])
    if how == "inner":
        return out
    # Rows of one place share their fate, so places are told apart and not rows.
    met = out.select(*[F.col(c).alias(f"_m_{c}") for c in (*key, at)]).distinct()
    same = [F.col(c) == F.col(f"_m_{c}") for c in (*key, at)]
    none = [F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in extra]
    return out.unionByName(rows.join(met, same, "left_anti").select("*", *none))


def interval_lookup(
    rows: DataFrame,
    intervals: DataFrame,
    key: Sequence[str],
    at: str,
    low: str,
    high: str,
    cols: Sequence[str],
    tile: int = TILE,
) -> DataFrame:
    """All rows, with ``cols`` of the one interval of their key that holds ``at`` (null where none does).

    The intervals of a key don't overlap, so the one in question is the last that starts at ``at`` or
    before.  An interval is one row of the sequence however long it is.
    """
    key = list(key)
    rest = [c for c in rows.columns if c not in (*key, at)]
    mine = F.struct(F.lit(True).alias("_is"), *rest)
    mark = F.struct(F.col(high).alias("_to"), *cols)
    r = rows.select(*key, F.col(at).alias("_at"), mine.alias("_row"))
    m = intervals.where(F.col(low).isNotNull()).select(*key, F.col(low).alias("_at"), mark.alias("_mark"))
    both = r.unionByName(m, allowMissingColumns=True)
    # Marks come before the rows of their place.
    both = both.withColumn("_o", F.col("_at") * 2 + F.col("_row").isNotNull().cast("int"))
    found = nearest(both, key, "_o", prev={"_held": "_mark"}, where=F.col("_mark").isNotNull(), tile=2 * tile).where("_row is not null")
    inside = F.col("_at") <= F.col("_held._to")
    return found.select(
        *[F.col(c) if c in key else F.col("_at").alias(c) if c == at else F.col(f"_row.{c}").alias(c) for c in rows.columns],
        *[F.when(inside, F.col(f"_held.{c}")).alias(c) for c in cols],
    )


def laid_out(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows in ranges of (key, order), stored; ``_part`` is the range and ``_at`` the place in it, from 0.

    A range holds about an equal share of all rows whatever the keys are, so a hot key lies in many ranges.
    The ranges come from a sample; storing them fixes them for all that is read later.
    """
    by = [*key, *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stage(rows.select("*", F.spark_partition_id().alias("_part"), at.alias("_at")), name)


def numbered(laid: DataFrame, key: Sequence[str], name: str = "pos", total: str | None = None) -> DataFrame:
    """0-based ordinal of each row of ``laid_out`` rows within its key (and the number of the key's rows).

    Only counts are added up across ranges: one row for each key in each range, so a key has at most as
    many as there are ranges.  Null keys are a key of their own.
    """
    key = list(key)
    runs = laid.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # Rows of one range under an empty key would meet in one task: the ranges' counts themselves are few.
    own = W.partitionBy(*key) if key else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(_UNB, -1)), F.lit(0))
    whole = F.sum("_n").over(own)
    runs = runs.select(*key, "_part", (before - F.col("_first")).alias("_shift"), whole.alias("_total"))
    # A key value is matched by equality or by both being null.
    on = F.col("a._part") == F.col("b._part")
    for c in key:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    out = laid.alias("a").join(runs.alias("b"), on)
    cols = [F.col(f"a.{c}") for c in laid.columns if c not in ("_part", "_at")]
    return out.select(
        *cols,
        (F.col("a._at") + F.col("b._shift")).alias(name),
        *([F.col("b._total").alias(total)] if total else []),
    )
