"""Exact percentiles by distributed selection.

Equal values of a key are counted first, so repeats never travel.  The distinct values are dealt out by key
and by a range of the value, ``RANGES`` to each doubling; how many values each range holds, added up in order,
tells which ranges hold the wanted ranks, and only these are put in order.  All keys go the same way: no range
gathers more than a small share of a key's distinct values, and no sum runs over more than its ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 256
#: Beyond the exponents of doubles, on both sides of zero.
_FAR = 1100 * RANGES


def value_range(v: Column) -> Column:
    """Number of the range of a double: grows with the value; zero, infinities and NaN have their own."""
    size = F.floor(F.greatest(F.lit(-float(_FAR)), F.least(F.lit(float(_FAR)), F.log2(F.abs(v)) * RANGES))) + (_FAR + 1)
    return F.when(v == 0, F.lit(0)).when(F.isnan(v), F.lit(2 * _FAR + 2)).when(v < 0, -size).otherwise(size).cast("int")


def exact_percentiles(df: DataFrame, key: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """One row per key with the linearly interpolated percentiles of ``value``; nulls don't count.

    Keys of equal values, nulls among them, are one key.  ``df`` is read once: what is counted and what is
    picked come from the same exchange.
    """
    key = list(key)
    group = F.struct(*[F.col(c) for c in key]) if key else F.struct(F.lit(0).alias("_all"))
    rows = df.where(F.col(value).isNotNull()).select(group.alias("_k"), F.col(value).cast("double").alias("_v"))
    # Never null, so that a join adds no condition to one of the two readers of the exchange.
    rows = rows.select("_k", F.coalesce(value_range(F.col("_v")), F.lit(0)).alias("_r"), "_v")
    counted = rows.groupBy("_k", "_r", "_v").agg(F.count(F.lit(1)).alias("_c"))
    dealt = counted.repartition("_k", "_r")

    whole = W.partitionBy("_k")
    before = F.sum("_n").over(whole.orderBy("_r").rowsBetween(W.unboundedPreceding, -1))
    ranges = (
        dealt.groupBy("_k", "_r")
        .agg(F.sum("_c").alias("_n"))
        .select("_k", "_r", "_n", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("_total"))
    )
    # Of each percentile the rank below and the rank above it, counted inside the range.
    names, ranks = list(probs), []
    for i, p in enumerate(probs.values()):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in enumerate((F.floor(at), F.ceil(at))):
            ranks.append(F.struct(F.lit(2 * i + side).alias("i"), (rank - F.col("_start")).alias("rank")))
    held = F.filter(F.array(*ranks), lambda t: (t["rank"] >= 0) & (t["rank"] < F.col("_n")))
    wanted = ranges.select("_k", "_r", "_total", held.alias("_t")).where(F.size("_t") > 0)

    run = W.partitionBy("_k", "_r").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    picked = (
        dealt.join(wanted, ["_k", "_r"])
        .select("_k", "_total", "_t", "_v", "_c", F.sum("_c").over(run).alias("_upto"))
        .select(
            "_k",
            "_total",
            "_v",
            F.explode(F.filter("_t", lambda t: (t["rank"] < F.col("_upto")) & (t["rank"] >= F.col("_upto") - F.col("_c")))).alias("_t"),
        )
    )
    found = picked.groupBy("_k").agg(
        F.first("_total").alias("_total"), *[F.max(F.when(F.col("_t.i") == j, F.col("_v"))).alias(f"_q{j}") for j in range(2 * len(names))]
    )

    def between(i: int, p: float) -> Column:
        a, z, at = F.col(f"_q{2 * i}"), F.col(f"_q{2 * i + 1}"), F.lit(float(p)) * (F.col("_total") - 1)
        # The built-in aggregate weighs the two neighbours in this way.
        return F.when(a == z, a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * z)

    return found.select(*[F.col(f"_k.{c}").alias(c) for c in key], *[between(i, p).alias(n) for i, (n, p) in enumerate(probs.items())])
