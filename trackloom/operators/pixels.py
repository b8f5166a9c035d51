"""Jobs over pixel tables (movie, channel, frame, y, x, v)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from trackloom.functions.geometry import lines, point_at
from trackloom.functions.sampling import corners, mirrored_weights, sampled, weighted_sums
from trackloom.operators.ordered import spread
from trackloom.operators.quantiles import exact_percentiles
from trackloom.plans.stages import stage

_SIDE = 16
#: Words of 64 bits in the map of touched blocks: half a megabyte, whatever the input.
_WORDS = 1 << 16
#: Where pixels meet samples of lines: side of a block, its frames, and parts of the samples of a block.
_TILE, _FRAMES, _PARTS = 32, 32, 8
_TILED = ["movie", "roi", "channel", "_bs", "_bf"]
_PLACE = ["_x", "_y", "_nx", "_ny", "_h", "_w"]
#: Rows put together at a time, and samples that are worked out at a time.
_HELD, _CELLS = 1 << 15, 1 << 17
WINDOW = ["movie", "channel", "frame", "trajectory"]


def explode_frames(frames: DataFrame, values: str, width: int) -> DataFrame:
    """Row-major frame arrays to one row per pixel."""
    out = frames.select(*[c for c in frames.columns if c != values], F.posexplode(values).alias("_p", "v"))
    return (
        out.withColumn("y", F.floor(F.col("_p") / width).cast("int"))
        .withColumn("x", (F.col("_p") % width).cast("int"))
        .withColumn("v", F.col("v").cast("double"))
        .drop("_p")
    )


def _block_hash() -> Column:
    """Hash of a 16 x 16 block of one frame, of the same types on both sides."""
    places = [F.col(c).cast("bigint") for c in ("channel", "frame", "_by", "_bx")]
    return F.pmod(F.xxhash64(F.col("movie").cast("string"), *places), F.lit(_WORDS * 64))


def touched_blocks(blocks: DataFrame) -> Column:
    """Whether a row's block (movie, channel, frame, _by, _bx) can be one of ``blocks``.

    A bit map of fixed size, made by one aggregation and read as a scalar subquery, so the scan of the
    other side drops rows before they are shuffled.  A full map lets more rows through and loses none.
    """
    h = _block_hash()
    bit = (h % 64).cast("int")
    words = blocks.select(
        F.shiftright(h, 6).alias("id"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bits")
    )
    empty = blocks.sparkSession.range(0, _WORDS, 1, 1).select("id", F.lit(0).cast("bigint").alias("bits"))
    dense = empty.unionByName(words).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    bitmap = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda w: w.bits).alias("_map"))
    word = F.get(bitmap.scalar(), F.shiftright(h, 6).cast("int"))
    return F.call_function("shiftright", word, bit).bitwiseAND(F.lit(1).cast("bigint")) == 1


def _in_blocks_of(windows: DataFrame, side: int, x_low: Column, x_high: Column, y_low: Column, y_high: Column) -> DataFrame:
    """A row for each block of ``side`` x ``side`` that a window touches."""

    def blocks(low: Column, high: Column) -> Column:
        low, high = F.greatest(low, F.lit(0)), F.greatest(high - 1, F.lit(0))
        return F.explode(F.sequence(F.floor(low / side), F.floor(F.greatest(low, high) / side)))

    sized = windows.withColumns({"_x0": x_low, "_x1": x_high, "_y0": y_low, "_y1": y_high})
    return sized.withColumn("_bx", blocks(F.col("_x0"), F.col("_x1"))).withColumn("_by", blocks(F.col("_y0"), F.col("_y1")))


def crop_pixels(
    windows: DataFrame,
    pixels: DataFrame,
    x_low: Column,
    x_high: Column,
    y_low: Column,
    y_high: Column,
    how: str = "inner",
) -> DataFrame:
    """Pixels with x_low <= x < x_high and y_low <= y < y_high of each window.

    Windows and pixels meet in 16 x 16 blocks of one frame, so a window is sent
    to the few blocks it touches and not once per pixel.
    """

    w = _in_blocks_of(windows, _SIDE, x_low, x_high, y_low, y_high)
    p = pixels.withColumns({"_bx": F.floor(F.col("x") / _SIDE), "_by": F.floor(F.col("y") / _SIDE)})
    p = p.where(touched_blocks(w)).alias("p")
    w = w.alias("w")
    cond = (F.col("p.x") >= F.col("w._x0")) & (F.col("p.x") < F.col("w._x1"))
    cond = cond & (F.col("p.y") >= F.col("w._y0")) & (F.col("p.y") < F.col("w._y1"))
    for c in ("movie", "channel", "frame", "_by", "_bx"):
        cond = cond & (F.col(f"w.{c}") == F.col(f"p.{c}"))
    return w.join(p, cond, how).select(*[F.col(f"w.{c}") for c in windows.columns], *[F.col(f"p.{c}") for c in "yxv"])


def crop_pages(
    windows: DataFrame, pixels: DataFrame, page: int, x_low: Column, x_high: Column, y_low: Column, y_high: Column
) -> DataFrame:
    """The pixels of ``crop_pixels`` that aren't null, as a list ``_p`` (at, v) for each window and page (``row``, ``col``).

    ``at`` is the pixel's number inside the page of ``page`` x ``page``.  Pixels are put together before they meet
    the windows, so no task holds a row for each pixel of each window.
    """
    w = _in_blocks_of(windows, page, x_low, x_high, y_low, y_high)
    block = ["movie", "channel", "frame", "_by", "_bx"]
    inside = (F.pmod("y", F.lit(page)) * page + F.pmod("x", F.lit(page))).cast("int")
    p = pixels.withColumns({"_bx": F.floor(F.col("x") / page), "_by": F.floor(F.col("y") / page)})
    p = p.where(F.col("v").isNotNull() & touched_blocks(w)).select(*block, F.struct(inside.alias("at"), F.col("v").cast("double").alias("v")).alias("_q"))
    # Dealt before they are grouped: lists put together on the reading side would have to be sorted there.
    p = p.repartition(*block).groupBy(*block).agg(F.sort_array(F.collect_list("_q")).alias("_all"))
    met = w.join(p, block)
    x0, y0 = F.col("_bx") * page, F.col("_by") * page
    whole = (F.col("_x0") <= x0) & (F.col("_x1") >= x0 + page) & (F.col("_y0") <= y0) & (F.col("_y1") >= y0 + page)

    def within(q: Column) -> Column:
        x, y = x0 + q["at"] % page, y0 + F.floor(q["at"] / page)
        return (x >= F.col("_x0")) & (x < F.col("_x1")) & (y >= F.col("_y0")) & (y < F.col("_y1"))

    kept = F.when(whole, F.col("_all")).otherwise(F.filter("_all", within))
    # Made by a generator, so that the lists are not filtered again for each use.
    out = met.select(*windows.columns, F.col("_by").cast("int").alias("row"), F.col("_bx").cast("int").alias("col"), F.explode(F.array(kept)).alias("_p"))
    return out.where(F.size("_p") > 0)


def search_crops(windows: DataFrame, pixels: DataFrame, radius: int) -> DataFrame:
    """Square crop around each search centre, clipped to the image; rounds half to even."""
    cx, cy = F.bround("search_x").cast("int"), F.bround("search_y").cast("int")
    return crop_pixels(windows, pixels, cx - radius, cx + radius, cy - radius, cy + radius)


def snr_gate(crops: DataFrame, snr: float = 4.0, group: Sequence[str] = WINDOW) -> DataFrame:
    """Windows (crops are small) whose maximum stands out from the median."""
    return (
        crops.groupBy(*group)
        .agg(F.max("v").alias("max_v"), F.median("v").alias("median_v"), F.stddev_pop("v").alias("std_v"))
        .withColumn("passes", F.col("max_v") - F.col("median_v") >= snr * F.col("std_v"))
    )


def lower_half_background(crops: DataFrame, group: Sequence[str] = WINDOW) -> DataFrame:
    """Median of the pixels below the middle of the value range, else the minimum."""
    w = W.partitionBy(*group)
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    rows = crops.withColumn("_lo", lo).withColumn("_cut", lo + 0.5 * (hi - lo))
    return rows.groupBy(*group).agg(
        F.coalesce(F.median(F.when(F.col("v") < F.col("_cut"), F.col("v"))), F.min("_lo")).alias("background")
    )


def strip_width(y0: Column, y1: Column, x0: Column, x1: Column, share: float) -> Column:
    return F.greatest(F.lit(1), F.floor(F.least(y1 - y0, x1 - x0) * share).cast("int"))


def strip_count(y0: Column, y1: Column, x0: Column, x1: Column, b: Column, sides: Sequence[Column] | None = None) -> Column:
    """In how many of the four border strips (b wide) of [x0, x1) x [y0, y1) the pixel (x, y) lies.

    ``sides`` says for top, bottom, left, right whether the strip counts.
    """
    y, x = F.col("y"), F.col("x")
    hits = [y < y0 + b, y >= y1 - b, x < x0 + b, x >= x1 - b]
    if sides is not None:
        hits = [h & s for h, s in zip(hits, sides)]
    total = hits[0].cast("int")
    for h in hits[1:]:
        total = total + h.cast("int")
    return total


def trajectory_background(
    windows: DataFrame,
    pixels: DataFrame,
    movies: DataFrame,
    radius: int = 12,
    border: float = 0.1,
) -> DataFrame:
    """Median of the border pixels of all crops of a trajectory.

    Sides cut by the image edge give no pixels; a pixel in two strips counts twice.
    """
    cx, cy = F.bround("search_x").cast("int"), F.bround("search_y").cast("int")
    x0, x1, y0, y1 = cx - radius, cx + radius, cy - radius, cy + radius
    h, w = F.col("height"), F.col("width")
    # Everything that is the same for a whole window is worked out before the pixels come in.
    sized = windows.join(movies.select("movie", "height", "width"), "movie").withColumns(
        {
            "_top": y0 >= 0,
            "_bottom": y1 <= h,
            "_left": x0 >= 0,
            "_right": x1 <= w,
            "_ya": F.greatest(y0, F.lit(0)),
            "_yb": F.least(y1, h),
            "_xa": F.greatest(x0, F.lit(0)),
            "_xb": F.least(x1, w),
        }
    )
    sized = sized.withColumn("_strip", strip_width(F.col("_ya"), F.col("_yb"), F.col("_xa"), F.col("_xb"), border))
    rows = search_crops(sized, pixels, radius)
    whole = [F.col(c) for c in ("_top", "_bottom", "_left", "_right")]
    n = strip_count(F.col("_ya"), F.col("_yb"), F.col("_xa"), F.col("_xb"), F.col("_strip"), whole)
    border_rows = rows.withColumn("_n", n).where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), "_n")))
    key = ["movie", "trajectory"]
    return exact_percentiles(border_rows, key, "v", {"trajectory_background": 0.5})


def max_projection(pixels: DataFrame, movies: DataFrame) -> DataFrame:
    """Maximum over frames; a one-channel movie of up to four frames gives its first frame."""
    m = movies.select("movie", ((F.col("n_channels") <= 1) & (F.col("n_frames") <= 4)).alias("_short"))
    rows = pixels.join(m, "movie").where(~F.col("_short") | (F.col("frame") == 0))
    return rows.groupBy("movie", "channel", "y", "x").agg(F.max("v").alias("v"))


def contrast_limits(
    pixels: DataFrame,
    group: Sequence[str] = ("movie", "channel", "frame"),
    mode: str = "frame",
) -> DataFrame:
    """Display limits from percentiles; modes frame, projection and log."""
    # Percentiles and factors per mode.
    p_low, p_high, f_low, f_high = {
        "frame": (0.15, 0.99, 1.0, 1.1),
        "projection": (0.15, 0.99, 1.05, 1.2),
        "log": (0.35, 0.98, 1.0, 1.0),
    }[mode]
    q = exact_percentiles(pixels, list(group), "v", {"_a": p_low, "_z": p_high})
    lo, hi = (F.col("_a") * f_low).cast("int"), (F.col("_z") * f_high).cast("int")
    out = q.select(*group, lo.alias("vmin"), hi.alias("vmax"))
    delta = F.col("vmax") - F.col("vmin")
    return out.withColumn("ext_min", F.col("vmin") - (delta * 0.7).cast("int")).withColumn(
        "ext_max", F.col("vmax") + (delta * 1.4).cast("int")
    )


def _bin(bins: int) -> Column:
    """Bin of v between _lo and _hi: bin i holds edge i up to, but not, edge i + 1; the last one holds _hi, too.

    Edges are _lo + i * step; a quotient that rounds to the other side of one is put right.
    """
    v, lo = F.col("v"), F.col("_lo")
    step = (F.col("_hi") - lo) / bins
    i = F.least(F.floor((v - lo) * bins / (F.col("_hi") - lo)), F.lit(bins - 1))
    up = (i < bins - 1) & (v >= (i + 1) * step + lo)
    return F.when(v < i * step + lo, i - 1).when(up, i + 1).otherwise(i).cast("int")


def pixel_histogram(
    windows: DataFrame, pixels: DataFrame, radius: int = 12, bins: int = 50, group: Sequence[str] = WINDOW
) -> DataFrame:
    """Counts per bin of each crop, and of the pixels within two sigma of its centre.

    Windows carry ``sigma``.  A flat crop is widened by half on both sides.
    """
    rows = search_crops(windows, pixels, radius)
    w = W.partitionBy(*group)
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    rows = rows.withColumn("_lo", F.when(hi > lo, lo).otherwise(lo - 0.5)).withColumn(
        "_hi", F.when(hi > lo, hi).otherwise(hi + 0.5)
    )
    dx, dy = F.col("x") - F.bround("search_x"), F.col("y") - F.bround("search_y")
    core = F.sqrt(dx * dx + dy * dy) <= 2 * F.col("sigma")
    return rows.groupBy(*group, _bin(bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(core).alias("core_pixels")
    )


def image_histogram(
    pixels: DataFrame, bins: int = 50, group: Sequence[str] = ("movie", "channel", "frame")
) -> DataFrame:
    """Counts per bin of whole images; a flat image is widened by half on both sides, NULL values don't count.

    The range of each image comes first, then one pass puts the pixels into bins; both add up inside the
    tasks, so no task needs a whole image.
    """
    group = list(group)
    known = pixels.where("v is not null").select(*group, "v")
    flat = F.max("v") <= F.min("v")
    span = known.groupBy(*group).agg(
        F.when(flat, F.min("v") - 0.5).otherwise(F.min("v")).alias("_lo"),
        F.when(flat, F.max("v") + 0.5).otherwise(F.max("v")).alias("_hi"),
    )
    return known.join(span, group).groupBy(*group, _bin(bins).alias("bin")).agg(F.count(F.lit(1)).alias("pixels"))


def histograms(windows: DataFrame, pixels: DataFrame, radius: int = 12, bins: int = 50) -> DataFrame:
    """``pixel_histogram`` of windows that have a centre; the others get their whole image and no core counts."""
    centred = F.lit(True)
    for c in ("search_x", "search_y"):
        centred = centred & F.col(c).isNotNull() & ~F.isnan(c)
    image = ["movie", "channel", "frame"]
    whole = windows.where(~centred).select(*WINDOW)
    frames = image_histogram(pixels.join(whole, image, "left_semi"), bins, image)
    rest = whole.join(frames, image).select(*WINDOW, "bin", "pixels", F.lit(None).cast("bigint").alias("core_pixels"))
    return pixel_histogram(windows.where(centred), pixels, radius, bins).unionByName(rest)


def _sampled(rois: DataFrame, *keep: str) -> DataFrame:
    """Sample places along every ROI row: s, the place _x, _y and the unit normal _nx, _ny."""
    n = F.col("width")
    r = lines(rois, *keep)
    r = r.withColumn("s", F.explode(F.sequence(F.lit(0), n - 1)))

    def at(k: Column) -> Column:
        return point_at(k * F.col("total") / (n - 1))

    r = r.select(
        "movie",
        "roi",
        "s",
        *keep,
        at(F.col("s")).alias("_p"),
        at(F.greatest(F.col("s") - 1, F.lit(0))).alias("_a"),
        at(F.least(F.col("s") + 1, n - 1)).alias("_b"),
    )
    tx, ty = F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")
    norm = F.sqrt(tx * tx + ty * ty)
    nx, ny = F.when(norm > 0, -ty / norm).otherwise(F.lit(0.0)), F.when(norm > 0, tx / norm).otherwise(F.lit(0.0))
    return _once(r, ["movie", "roi", "s", *keep], _x=F.col("_p.x"), _y=F.col("_p.y"), _nx=nx, _ny=ny)


def _once(df: DataFrame, kept: Sequence[str], **cols: Column) -> DataFrame:
    """``kept`` and new columns that are worked out once per row, however often later steps use them."""
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def _put_together(batches: Iterator[pa.RecordBatch], by: Sequence[str], make: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """Rows that ``make`` gives, with equal ``by`` as one row and the other columns as lists, some ten thousands at a time."""

    def packed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = make(pa.Table.from_batches(held))
        rest = [c for c in t.column_names if c not in by]
        found = t.group_by(list(by), use_threads=False).aggregate([(c, "list") for c in rest])
        return found.rename_columns([c.removesuffix("_list") if c not in by else c for c in found.column_names]).combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= _HELD:
            yield from packed(held)
            held = []
    if held:
        yield from packed(held)


def _lists(df: DataFrame, kept: Sequence[StructField], lists: Sequence[str]) -> StructType:
    """Type of ``kept`` columns and lists of columns of ``df``."""
    return StructType([*kept, *[StructField(c, ArrayType(df.schema[c].dataType)) for c in lists]])


def _tiled_pixels(pixels: DataFrame, halo: int) -> DataFrame:
    """Groups of frames cut into blocks (_by, _bx) that overlap by ``halo``: frame, place in the block and value of each pixel.

    Pixels of one place add up.
    """
    span = _TILE + halo

    def home(c: str) -> Column:
        return F.explode(F.sequence(F.greatest(F.floor((F.col(c) - halo) / _TILE), F.lit(0)), F.floor(F.col(c) / _TILE)))

    block = ["movie", "channel", "_by", "_bx", "_t"]
    rows = pixels.where("x >= 0 and y >= 0").withColumn("_by", home("y")).withColumn("_bx", home("x"))
    place = (F.col("y") - F.col("_by") * _TILE) * span + F.col("x") - F.col("_bx") * _TILE
    rows = rows.withColumn("_t", F.floor(F.col("frame") / _FRAMES)).where("movie is not null and _t is not null")
    rows = spread(rows.select(*block, "frame", place.cast("int").alias("i"), "v"), *block)
    one = rows.groupBy(*block, "frame", "i").agg(F.sum("v").cast("double").alias("v"))
    out = one.groupBy(*block).agg(F.collect_list(F.struct("frame", "i", "v")).alias("_e"))
    return out.select(*block, F.col("_e.frame").alias("_frame"), F.col("_e.i").alias("_i"), F.col("_e.v").alias("_v"))


def _dense(half_width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Groups of frames of a block as bytes: a value for each place, and whether it has one (1), or none though it is there (2).

    A last place stands for none.  Bytes are copied whole where they meet the packs of places.
    """
    span = _TILE + 2 * half_width + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                r = {c: b.column(c)[at].values for c in ("_frame", "_i", "_v")}
                frames = r["_frame"].dictionary_encode()
                cell = np.asarray(frames.indices), np.asarray(r["_i"])
                gone = np.asarray(r["_v"].is_null())
                values = np.zeros((len(frames.dictionary), span * span + 1))
                state = np.zeros(values.shape, np.uint8)
                values[cell] = np.where(gone, 0.0, r["_v"].to_numpy(zero_copy_only=False))
                state[cell] = np.where(gone, 2, 1)
                made = {"_frame": pa.ListArray.from_arrays([0, len(values)], frames.dictionary), "_v": pa.array([values.tobytes()]), "_state": pa.array([state.tobytes()])}
                kept = [c for c in b.schema.names if c not in r]
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(at, 1) for c in kept], *made.values()], [*kept, *made])

    return run


def _place(columns: pa.Table | dict[str, pa.Array]) -> dict[str, np.ndarray]:
    return {c: np.asarray(columns[c]) for c in _PLACE}


def _packs(places: DataFrame, half_width: int) -> DataFrame:
    """Places of lines put together by the block that holds all their pixels, as lists."""
    by = ["movie", "_part", "_by", "_bx"]

    def make(t: pa.Table) -> pa.Table:
        xs, ys, _ = corners(_place(t), half_width)
        for c, v in (("_by", ys), ("_bx", xs)):
            t = t.append_column(c, pa.array(v.min(axis=(0, 1)) // _TILE))
        return t

    kept = [*[places.schema[c] for c in ("movie", "_part")], StructField("_by", LongType()), StructField("_bx", LongType())]
    return places.mapInArrow(lambda batches: _put_together(batches, by, make), _lists(places, kept, ["roi", "s", *_PLACE]))


def _met(half_width: int, method: str | None, schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a pack of places and a group of frames of their block: a row for each place and frame.

    ``method`` puts the samples across the line together; without one they are columns.
    """
    span = _TILE + 2 * half_width + 2
    n_off = 2 * half_width + 1
    names = [f.name for f in schema]

    def across(o: np.ndarray, lacks: np.ndarray | None) -> dict[str, pa.Array]:
        if method is None:
            return {f"_o{k}": pa.array(o[:, k].ravel(), mask=None if lacks is None else lacks[:, k].ravel()) for k in range(n_off)}
        if method == "max":
            v = (o if lacks is None else np.where(lacks, -np.inf, o)).max(axis=1)
            return {"v": pa.array(v.ravel(), mask=None if lacks is None else lacks.all(axis=1).ravel())}
        o = o if lacks is None else np.where(lacks, 0.0, o)
        v = o[:, 0]
        for k in range(1, n_off):
            v = v + o[:, k]
        return {"v": pa.array((v / n_off).ravel())}

    def rows(b: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
        r = {c: b.column(c)[at].values if pa.types.is_list(b.schema.field(c).type) else b.column(c)[at] for c in b.schema.names}
        xs, ys, weights = corners(_place(r), half_width)
        cell = (ys - r["_by"].as_py() * _TILE) * span + xs - r["_bx"].as_py() * _TILE
        part = (weights > 0) | np.isnan(weights)
        cell, weights = np.where(part, cell, span * span), np.where(part, weights, 0.0)
        frames = r["_frame"]
        values, state = (np.frombuffer(r[c].as_buffer(), kind).reshape(len(frames), -1) for c, kind in (("_v", np.float64), ("_state", np.uint8)))
        known, blank = state == 1, state == 2
        n, step = cell.shape[2], max(1, _CELLS // cell[0].size)
        for f in range(0, len(frames), step):
            o, lacks = sampled(values[f : f + step], known[f : f + step], cell, weights)
            m = len(o)
            out = {
                "movie": pa.repeat(r["movie"], m * n),
                "roi": pa.concat_arrays([r["roi"]] * m),
                "channel": pa.repeat(r["channel"], m * n),
                "frame": frames.take(pa.array(np.repeat(np.arange(f, f + m), n))),
                "s": pa.concat_arrays([r["s"]] * m),
                **across(o, lacks),
            }
            found = pa.RecordBatch.from_arrays([out[c] for c in names], names)
            if lacks is not None:
                # Places whose pixels are all missing have no row; those of pixels without a value do.
                there = ~lacks.all(axis=1) | blank[f : f + step][:, cell].any(axis=(1, 2))
                found = found.filter(pa.array(there.ravel()))
            yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            for at in range(b.num_rows):
                for found in rows(b, at):
                    held.append(found)
                    if sum(h.num_rows for h in held) >= _HELD:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def kymograph(
    pixels: DataFrame, rois: DataFrame, movies: DataFrame, half_width: int = 2, method: str = "max"
) -> DataFrame:
    """(movie, roi, channel, frame, s, v): bilinear samples, then max or mean across the line.

    All pixels of a sample lie in one block, so its place goes once to each group of frames of its block,
    put together with others of that block, and its values are made where they meet, as arrays: nothing
    is shuffled for each of its corners or frames.  The places of a block are dealt over some tasks, as
    many lines may cross a bright place.
    """
    halo = 2 * half_width + 2
    times = pixels.groupBy("movie").agg(F.collect_set(F.floor(F.col("frame") / _FRAMES)).alias("_times"))
    sized = rois.select("movie", "roi", "x", "y").join(
        F.broadcast(movies.select("movie", F.col("height").cast("long").alias("_h"), F.col("width").cast("long").alias("_w"))), "movie"
    )
    # Records of one ROI id add up.
    sized = spread(sized, "movie", "roi").withColumn("_many", F.count(F.lit(1)).over(W.partitionBy("movie", "roi")) > 1)
    part = F.pmod(F.xxhash64("roi", F.floor(F.col("s") / 64)), F.lit(_PARTS)).alias("_part")
    places = _sampled(sized, "_h", "_w", "_many").where(" and ".join(f"{c} is not null" for c in _PLACE))
    blocks = _tiled_pixels(pixels, halo)
    block = [blocks.schema[c] for c in ("movie", "channel", "_by", "_bx", "_t", "_frame")]
    blocks = blocks.mapInArrow(_dense(half_width), StructType([*block, StructField("_v", BinaryType()), StructField("_state", BinaryType())]))
    blocks = blocks.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_PARTS - 1).cast("bigint"))))
    meet = ["movie", "_by", "_bx", "_t", "_part"]
    blocks = spread(blocks, *meet)
    key = ["movie", "roi", "channel", "frame", "s"]
    types = StructType([(pixels if c in ("channel", "frame") else places).schema[c] for c in key])

    def met(some: Column, method: str | None, values: Sequence[str]) -> DataFrame:
        packs = _packs(places.where(some).select("movie", "roi", "s", part, *_PLACE), half_width)
        packs = packs.join(F.broadcast(times), "movie").withColumn("_t", F.explode("_times")).drop("_times")
        # Both sides were multiplied, which their estimated sizes do not tell: neither is broadcast.
        both = spread(packs, *meet).hint("merge").join(blocks.hint("merge"), meet)
        schema = StructType([*types, *[StructField(c, DoubleType()) for c in values]])
        return both.mapInArrow(_met(half_width, method, schema), schema)

    names = [f"_o{k}" for k in range(2 * half_width + 1)]
    several = met(F.col("_many"), None, names).groupBy(*key).agg(*[F.sum(name).alias(name) for name in names])
    cols = [F.col(name) for name in names]
    if method == "max":
        v = F.greatest(*cols) if len(cols) > 1 else cols[0]
    else:
        total_v = F.coalesce(cols[0], F.lit(0.0))
        for c in cols[1:]:
            total_v = total_v + F.coalesce(c, F.lit(0.0))
        v = total_v / len(cols)
    return met(~F.col("_many"), method, ["v"]).unionByName(several.select(*key, v.alias("v")))


def _kernels(sigma: float) -> tuple[list[float], list[float]]:
    radius = int(4 * sigma + 0.5)
    g = [math.exp(-0.5 * (j / sigma) ** 2) for j in range(radius + 1)]
    total = g[0] + 2 * sum(g[1:])
    g = [v / total for v in g]
    return g, [(j * j / sigma**4 - 1 / sigma**2) * v for j, v in enumerate(g)]


def _tiles(side: int, radius: int) -> Callable[[pa.Table], pa.Table]:
    """Adds the tile (_bs, _bf) of side x side samples and frames; rows near a tile's border are copied to its neighbours."""

    def make(t: pa.Table) -> pa.Table:
        moves = {}
        for c in ("s", "frame"):
            home, rest = np.divmod(np.asarray(t[c]).astype(np.int64), side)
            moves[c] = [(home, np.ones(len(home), bool)), (home - 1, (rest < radius) & (home > 0)), (home + 1, rest >= side - radius)]
        at, bs, bf = [], [], []
        for s, some in moves["s"]:
            for f, too in moves["frame"]:
                met = np.flatnonzero(some & too)
                at.append(met)
                bs.append(s[met])
                bf.append(f[met])
        t = t.take(pa.array(np.concatenate(at)))
        return t.append_column("_bs", pa.array(np.concatenate(bs))).append_column("_bf", pa.array(np.concatenate(bf)))

    return make


def _starts(t: pa.Table, by: Sequence[str]) -> np.ndarray:
    """Numbers of the rows that begin a run of equal ``by``."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in by:
        code = np.asarray(pc.dictionary_encode(t[c].combine_chunks(), null_encoding="encode").indices)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _logs(sigma: float, side: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Negative Laplacian of Gaussian of sorted tiles: a row of lists for each, without the rows copied from its neighbours."""
    g0, g2 = (tuple(g) for g in _kernels(sigma))
    radius = len(g0) - 1

    def beside(f: np.ndarray, column: np.ndarray, shape: tuple[int, int], v: np.ndarray, gone: np.ndarray, rank: np.ndarray, across: list, along: list) -> tuple[np.ndarray, np.ndarray]:
        """Sums of rows at (f, column), and which of them have a null value near; ``across`` and ``along`` are the weights of each rank of sizes."""
        cell = f * shape[1] + column

        def grid(some: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
            return np.bincount(cell[some], None if values is None else values[some], minlength=shape[0] * shape[1]).reshape(shape)

        values, a0, a2 = grid(~gone, v), np.zeros(shape), np.zeros(shape)
        for r, (w0, w2) in enumerate(across):
            n = grid(rank == r)
            # Sums of no rows aren't taken, as they needn't be finite.
            a0 += np.where(n > 0, n * weighted_sums([(values, w0)], 1), 0.0)
            a2 += np.where(n > 0, n * weighted_sums([(values, w2)], 1), 0.0)
        out = np.zeros(len(cell))
        for r, (w0, w2) in enumerate(along):
            out = np.where(rank == r, -weighted_sums([(a0, w2), (a2, w0)], 0).ravel()[cell], out)
        if not gone.any():
            return out, gone
        near = [np.ones((2 * radius + 1, n)) for n in shape]
        lost = (weighted_sums([(grid(gone) * 1.0, near[1])], 1) > 0) & (grid(rank >= 0) > 0)
        return out, weighted_sums([(lost * 1.0, near[0])], 0).ravel()[cell] > 0

    def tiles(t: pa.Table, starts: np.ndarray) -> pa.Table:
        lists = {c: t[c].combine_chunks().flatten() for c in ("frame", "s", "v")}
        f, s = (np.asarray(lists[c]).astype(np.int64) for c in ("frame", "s"))
        gone = np.asarray(lists["v"].is_null())
        v = np.where(gone, 0.0, lists["v"].to_numpy(zero_copy_only=False))
        each, tile = np.asarray(pc.list_value_length(t["v"])), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
        own_tile = np.repeat(tile, each)
        first = np.append(0, np.cumsum(np.bincount(own_tile, minlength=len(starts))))
        # ROI ids with several records have several sizes: a row's rank tells which.
        sizes, which = np.unique(np.stack([tile, t["width"], t["n_frames"]], axis=1), axis=0, return_inverse=True)
        at = np.searchsorted(sizes[:, 0], np.arange(len(starts) + 1))
        rank = np.repeat(which.ravel() - at[tile], each)
        low, high = ([ends.reduceat(x, first[:-1]) for x in (f, s)] for ends in (np.minimum, np.maximum))
        f0, s0, n_f, n_s = low[0], low[1], high[0] - low[0] + 1, high[1] - low[1] + 1
        lengths = [tuple(sizes[a:b, 2].tolist()) for a, b in zip(at, at[1:])]

        def weights(n: int, parts: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
            found = np.zeros((2 * radius + 1, n)), np.zeros((2 * radius + 1, n))
            for place, start, length, size in parts:
                for w, g in zip(found, (g0, g2)):
                    w[:, place : place + length] = mirrored_weights(g, start, length, size)
            return found

        out, lost = np.zeros(len(f)), np.zeros(len(f), bool)
        a = 0
        while a < len(starts):
            # Tiles of the same frames lie side by side, so far apart that they don't meet.
            b, height, wide = a, 0, 0
            while b < len(starts) and f0[b] == f0[a] and lengths[b] == lengths[a] and (b == a or max(height, n_f[b]) * (wide + n_s[b]) <= _CELLS):
                height, wide, b = max(height, n_f[b]), wide + n_s[b] + radius, b + 1
            here = slice(first[a], first[b])
            left = np.append(0, np.cumsum(n_s[a:b] + radius))[:-1]
            g = own_tile[here]
            ranks = range(int(rank[here].max()) + 1)
            one = lambda k, r: int(sizes[min(at[k] + r, at[k + 1] - 1), 1])
            across = [weights(wide, [(x, int(s0[k]), int(n_s[k]), one(k, r)) for k, x in zip(range(a, b), left.tolist())]) for r in ranks]
            along = [weights(height, [(0, int(f0[a]), int(height), lengths[a][r])]) for r in range(len(lengths[a]))]
            column = left[g - a] + s[here] - s0[g]
            out[here], lost[here] = beside(f[here] - f0[g], column, (int(height), int(wide)), v[here], gone[here], rank[here], across, along)
            a = b
        own = (s // side == np.asarray(t["_bs"])[starts][own_tile]) & (f // side == np.asarray(t["_bf"])[starts][own_tile])
        n = np.bincount(own_tile[own], minlength=len(starts))
        rows = {"frame": lists["frame"].filter(pa.array(own)), "s": lists["s"].filter(pa.array(own)), "_l": pa.array(out[own], mask=lost[own])}
        ends = pa.array(np.append(0, np.cumsum(n[n > 0])).astype(np.int32))
        keys = t.take(pa.array(starts[n > 0]))
        return pa.table([pa.ListArray.from_arrays(ends, rows[c]) if c in rows else keys[c] for c in schema.names], schema.names).cast(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            t = pa.concat_tables([*held, pa.Table.from_batches([b])])
            starts = _starts(t, _TILED)
            # The last tile may go on in the next batch.
            if len(starts) > 1:
                yield from tiles(t.slice(0, starts[-1]), starts[:-1]).to_batches()
            held = [t.slice(starts[-1])] if len(starts) else []
        for t in held:
            yield from tiles(t, np.zeros(1, np.int64)).to_batches()

    return run


def log_filter(kymo: DataFrame, sizes: DataFrame, sigma: float = 1.5, block: int = 512) -> DataFrame:
    """Negative Laplacian of Gaussian of kymographs, scaled to 1..255; flat ones give 128.

    ``sizes`` has movie, roi, width and n_frames.  Works in double precision.  A sum near a null value is null.
    Kymographs are dealt as lists, by tiles of ``block`` x ``block`` samples and frames with the rows around them,
    and filtered along both axes there as arrays, so a long line or movie spreads over tasks.
    """
    radius = len(_kernels(sigma)[0]) - 1
    side = max(block, radius)
    key = ["movie", "roi", "channel"]
    rows = kymo.where("frame is not null and s is not null").select(*key, "frame", "s", F.col("v").cast("double").alias("v"))
    tile = [*[rows.schema[c] for c in key], StructField("_bs", LongType()), StructField("_bf", LongType())]
    make = _tiles(side, radius)
    packs = rows.mapInArrow(lambda batches: _put_together(batches, _TILED, make), _lists(rows, tile, ["frame", "s", "v"]))
    packs = packs.join(sizes.select("movie", "roi", F.col("width").cast("int"), F.col("n_frames").cast("int")), ["movie", "roi"])
    listed = StructType([*_lists(rows, tile[:3], ["frame", "s"]), StructField("_l", ArrayType(DoubleType()))])
    both = packs.repartition(*_TILED).sortWithinPartitions(*_TILED).mapInArrow(_logs(sigma, side, to_arrow_schema(listed)), listed)
    both = stage(both.withColumns({"_lo": F.array_min("_l"), "_hi": F.array_max("_l")}), "log")
    span = both.groupBy(*key).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    out = both.drop("_lo", "_hi").join(span, key).select(*key, "_lo", "_hi", F.inline(F.arrays_zip("frame", "s", "_l")))
    scaled = F.floor((F.col("_l") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 254 + 1)
    return out.select(
        *key, "frame", "s", F.when(F.col("_hi") > F.col("_lo"), scaled).otherwise(128).cast("int").alias("v")
    )


def _moved(pixels: DataFrame, target_x: Column, target_y: Column, inside: Column) -> DataFrame:
    """Move every pixel to its wrapped place and blank it if it wrapped.

    Wrapping is one-to-one on a whole frame, so each place gets exactly one row
    and no join with an empty grid is needed.
    """
    return pixels.select(
        "movie",
        "channel",
        "frame",
        F.pmod(target_y, F.col("height")).cast("int").alias("y"),
        F.pmod(target_x, F.col("width")).cast("int").alias("x"),
        F.when(inside, F.col("v")).otherwise(F.lit(0.0)).alias("v"),
    )


def translate(pixels: DataFrame, movies: DataFrame, dx: int, dy: int) -> DataFrame:
    """Shift frames by whole pixels without wrapping; freed places are 0."""
    rows = pixels.join(movies.select("movie", "height", "width"), "movie")
    tx, ty = F.col("x") + dx, F.col("y") + dy
    inside = tx.between(0, F.col("width") - 1) & ty.between(0, F.col("height") - 1)
    return _moved(rows, tx, ty, inside)


def apply_drift(pixels: DataFrame, movies: DataFrame, offsets: DataFrame) -> DataFrame:
    """Undo the drift (movie, frame, dx, dy) in all channels, nearest pixel, outside 0."""
    rows = pixels.join(movies.select("movie", "height", "width"), "movie").join(
        offsets.select("movie", "frame", "dx", "dy"), ["movie", "frame"]
    )
    tx = F.col("x") - F.floor(F.col("dx") + 0.5)
    ty = F.col("y") - F.floor(F.col("dy") + 0.5)
    sx, sy = tx + F.col("dx"), ty + F.col("dy")
    inside = tx.between(0, F.col("width") - 1) & ty.between(0, F.col("height") - 1)
    inside = inside & sx.between(0, F.col("width") - 1) & sy.between(0, F.col("height") - 1)
    return _moved(rows, tx, ty, inside)
