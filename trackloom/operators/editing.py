"""Custom columns, selections, missing results, new ids."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.config import KEY
from trackloom.operators.ordered import laid_out, numbered

_COLOC = re.compile(r"^Ch\. (\d+) co\. %$")
_TYPED = re.compile(r"^(.*) \[(binary|value)\]$")
COMPUTED = ("D (μm²/s)", "α")


def custom_columns(columns: Sequence[str], known: Sequence[str], n_channels: int) -> list[tuple[str, str, str]]:
    """(header, name, type) of the extra columns; a header without a type is a value column."""
    out = []
    for c in columns:
        if c in known:
            continue
        coloc, typed = _COLOC.match(c), _TYPED.match(c)
        if c == "Colocalized w/any channel" or (typed and typed.group(1) in known):
            continue
        if coloc:
            if 1 <= int(coloc.group(1)) <= n_channels:
                out.append((c, c, "coloc"))
        elif typed:
            out.append((c, typed.group(1), typed.group(2)))
        else:
            out.append((c, c, "value"))
    return out


def read_custom_columns(df: DataFrame, known: Sequence[str], n_channels: int) -> DataFrame:
    """Fold the extra columns into one map ``custom``; whole numbers lose '.0', blanks are left out."""
    found = custom_columns(df.columns, known, n_channels)
    if not found:
        return df.select(*known, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("custom"))

    def text(header: str) -> Column:
        t = F.trim(F.col(f"`{header}`").cast("string"))
        return F.regexp_replace(F.nullif(t, F.lit("")), r"^(-?\d+)\.0$", "$1")

    pairs = F.create_map(*[x for h, n, _ in found for x in (F.lit(n), text(h))])
    return df.select(*[c for c in df.columns if c in known], F.map_filter(pairs, lambda _k, v: v.isNotNull()).alias("custom"))


def long_custom_columns(df: DataFrame) -> DataFrame:
    """One row per trajectory and custom field."""
    return df.select(*KEY, F.explode("custom").alias("name", "value"))


def _put(col: str, value: Column | str) -> Column:
    rest = F.map_filter("custom", lambda k, _v: k != col)
    return F.map_concat(rest, F.create_map(F.lit(col), F.lit(value) if isinstance(value, str) else value))


def _drop(col: str) -> Column:
    return F.map_filter("custom", lambda k, _v: k != col)


def toggle_binary(df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """Per movie: if every chosen trajectory is marked, unmark them all, else mark them all."""
    marked = F.coalesce(F.get(F.map_values(F.map_filter("custom", lambda k, _v: k == col)), 0) != "", F.lit(False))
    chosen = df.join(ids.select(*KEY).distinct().withColumn("_in", F.lit(True)), KEY, "left").withColumn("_marked", marked)
    every = chosen.where("_in").groupBy("movie").agg(F.bool_and("_marked").alias("_all"))
    out = chosen.join(every, "movie", "left")
    new = F.when(F.col("_in").isNull(), F.col("custom")).when(F.col("_all"), _drop(col)).otherwise(_put(col, "Yes"))
    return out.withColumn("custom", new).drop("_in", "_marked", "_all")


def set_value(df: DataFrame, col: str, ids: DataFrame, value: str) -> DataFrame:
    """Write a value for the chosen trajectories; computed columns cannot be edited."""
    if col in COMPUTED or _COLOC.match(col):
        raise ValueError(f"{col} is computed and cannot be edited")
    chosen = df.join(ids.select(*KEY).distinct().withColumn("_in", F.lit(True)), KEY, "left")
    new = F.when(F.col("_in"), _put(col, value)).otherwise(F.col("custom"))
    return chosen.withColumn("custom", new).drop("_in")


def add_column(df: DataFrame, col: str) -> DataFrame:
    """Give every trajectory the field, empty where it has none."""
    return df.withColumn("custom", F.when(F.map_contains_key("custom", col), F.col("custom")).otherwise(_put(col, "")))


def remove_column(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("custom", _drop(col))


def find_missing(trajectories: DataFrame, computed: DataFrame, group: Sequence[str] = KEY) -> DataFrame:
    """Trajectories (or segments) without a computed result."""
    group = list(group)
    return trajectories.select(*group).distinct().join(computed.select(*group).distinct(), group, "left_anti")


def missing_steps(trajectories: DataFrame, steps: DataFrame) -> DataFrame:
    """Trajectories without a stored step."""
    return find_missing(trajectories, steps.where("level IS NOT NULL"))


def missing_diffusion(trajectories: DataFrame, diffusion: DataFrame) -> DataFrame:
    """Trajectories that lack D or alpha."""
    known = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("d_um2_s", "alpha")]
    return find_missing(trajectories, diffusion.where(known[0] & known[1]))


def missing_segment_diffusion(trajectories: DataFrame, nodes: DataFrame, segments: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Trajectories with segments (two nodes, or two anchors, at least) but no stored segment result."""
    marks = nodes.select(*KEY, F.lit("n").alias("_kind"))
    if anchors is not None:
        marks = marks.unionByName(anchors.select(*KEY, F.lit("a").alias("_kind")))
    divided = marks.groupBy(*KEY, "_kind").count().where("count >= 2").select(*KEY).distinct()
    return find_missing(trajectories.join(divided, KEY, "left_semi"), segments)


def missing_colocalisation(trajectories: DataFrame, shares: DataFrame, movies: DataFrame) -> DataFrame:
    """Trajectories of movies with several channels that lack the share of another channel.

    ``trajectories`` has the channel, ``shares`` the columns chN_pct.
    """
    found = {int(c[2:-4]): c for c in shares.columns if c.startswith("ch") and c.endswith("_pct")}
    out = trajectories.join(movies.where("n_channels > 1").select("movie", "n_channels"), "movie").join(shares.select(*KEY, *found.values()), KEY, "left")
    lacks = F.greatest(F.lit(0), F.col("n_channels") - max(found, default=0)) > 0
    for n, c in found.items():
        lacks = lacks | ((F.lit(n) <= F.col("n_channels")) & (F.col("channel") != n) & F.col(c).isNull())
    return out.where(lacks).select(*KEY).distinct()


def to_compute(missing_values: DataFrame, missing_segments: DataFrame) -> DataFrame:
    """Trajectories that lack a value or a segment value."""
    return missing_values.select(*KEY).unionByName(missing_segments.select(*KEY)).distinct()


def category_codes(df: DataFrame, col: str, order: str, palette: int = 38) -> DataFrame:
    """Values in first-seen order with their place in a palette of the given size."""
    # Fixed value: 38, the number of colours of the palette.
    text = F.nullif(F.col(col).cast("string"), F.lit(""))
    seen = df.select(text.alias("value"), F.col(order).alias("_o")).where("value is not null")
    first = seen.groupBy("value").agg(F.min("_o").alias("first_seen"))
    rows = numbered(laid_out(first, [], ["first_seen", "value"], "categories"), [])
    return rows.select("value", "first_seen", (F.col("pos") % palette).cast("int").alias("code"))


def next_ids(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Number new rows from the largest trajectory id of their movie on (1 if there is none)."""
    top = existing.groupBy("movie").agg(F.max("trajectory").alias("_top"))
    rows = numbered(laid_out(new, ["movie"], [order], "new-rows"), ["movie"]).join(top, "movie", "left")
    return rows.withColumn("trajectory", F.coalesce("_top", F.lit(0)) + F.col("pos") + 1).drop("pos", "_top")
