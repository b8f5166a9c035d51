"""Candidate tracks of a kymograph: cleaning, acceptance, matching, selection.

Tracks: kymo, track, score, t_span, mean_prob.  Nodes: kymo, track, t, x.
The rules for acceptance, overlap, duplicates and fragment linking are defined
here from the meaning of their parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.config import FinderParams
from trackloom.operators.ordered import TILE, nearest
from trackloom.operators.quantiles import exact_percentiles
from trackloom.plans.stages import stage

ID = ["kymo", "track"]

#: A kymograph of at most so many nodes, of both tables together, is matched inside one task.
WHOLE = 1024


def clean_track_nodes(nodes: DataFrame, n_frames: int) -> DataFrame:
    """Whole frames inside the movie, the first node (by pos) per frame, tracks of two nodes or more."""
    t = F.bround("t").cast("int")
    one = (
        nodes.withColumn("t", t)
        .where(F.col("t").between(0, n_frames - 1) & F.col("x").isNotNull())
        .groupBy(*ID, "t")
        .agg(F.min_by("x", "pos").alias("x"))
    )
    # A track's frames, each once by now, travel as one list.
    lists = one.groupBy(*ID).agg(F.collect_list(F.struct("t", "x")).alias("_n")).where(F.size("_n") > 1)
    return lists.select(*ID, F.inline("_n")).withColumn("y", n_frames - 1 - F.col("t"))


def with_confidence(tracks: DataFrame) -> DataFrame:
    """Mean probability clipped to [0, 1]; missing counts as 0."""
    p = F.coalesce(F.when(~F.isnan("mean_prob"), F.col("mean_prob")), F.lit(0.0))
    return tracks.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def filter_tracks(tracks: DataFrame, threshold: float = FinderParams.prob_thresh) -> DataFrame:
    """Tracks that are not deleted and confident enough."""
    kept = ~F.coalesce("deleted", F.lit(False)) if "deleted" in tracks.columns else F.lit(True)
    return with_confidence(tracks).where(kept & (F.col("confidence") >= threshold))


def confidence_bounds(tracks: DataFrame) -> DataFrame:
    return with_confidence(tracks).groupBy("kymo").agg(F.min("confidence").alias("low"), F.max("confidence").alias("high"))


def judge_tracks(
    nodes: DataFrame,
    tracks: DataFrame,
    min_t_span: float = 3,
    min_len: float = 4.0,
    vmin: float = 0.0,
    min_directionality: float = 0.2,
    min_net_velocity: float = 0.0,
    min_mean_prob: float = 0.21,
    tile: int = TILE,
) -> DataFrame:
    """Measures per track and the first rule that it fails.

    Length is the path length in the (t, x) plane, step speed the mean of
    |dx| / dt, directionality |net dx| over the summed |dx| (1 if nothing moves).
    """
    s = nearest(nodes, ID, "t", prev={"_t": "t", "_x": "x"}, tile=tile)
    dt, dx = F.col("t") - F.col("_t"), F.col("x") - F.col("_x")
    per = s.groupBy(*ID).agg(
        (F.max("t") - F.min("t")).alias("span"),
        F.coalesce(F.sum(F.sqrt(dt * dt + dx * dx)), F.lit(0.0)).alias("length"),
        F.coalesce(F.avg(F.abs(dx) / dt), F.lit(0.0)).alias("step_speed"),
        F.sum(F.abs(dx)).alias("_sum"),
        F.abs(F.max_by("x", "t") - F.min_by("x", "t")).alias("_net"),
    )
    per = per.withColumn(
        "directionality", F.when(F.col("_sum") > 0, F.col("_net") / F.col("_sum")).otherwise(F.lit(1.0))
    ).withColumn("net_velocity", F.when(F.col("span") > 0, F.col("_net") / F.col("span")).otherwise(F.lit(0.0)))
    out = per.join(with_confidence(tracks).select(*ID, "confidence"), ID)
    # Names of the verdicts.
    verdict = (
        F.when(F.col("span") < min_t_span, "reject_t_span")
        .when(F.col("length") < min_len, "reject_length")
        .when(F.col("step_speed") < vmin, "reject_vmin")
        .when(F.col("directionality") < min_directionality, "reject_directionality")
        .when(F.col("net_velocity") < min_net_velocity, "reject_net_velocity")
        .when(F.col("confidence") < min_mean_prob, "reject_mean_prob")
        .otherwise("accepted")
    )
    return out.drop("_sum", "_net").withColumn("verdict", verdict)


def accept_tracks(judged: DataFrame) -> DataFrame:
    return judged.where("verdict = 'accepted'")


def verdict_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("verdict").agg(F.count(F.lit(1)).alias("tracks"))


def track_set_quality(tracks: DataFrame, group: Sequence[str] = ("kymo",)) -> DataFrame:
    """Four best scores, four longest spans, the longest span and the count, weighted."""
    group = list(group)

    def top(col: str, name: str) -> DataFrame:
        # The rank limit keeps at most four rows per group on every task before the shuffle.
        w = W.partitionBy(*group).orderBy(F.col(col).desc_nulls_last())
        value = F.coalesce(F.when(~F.isnan(col), F.col(col)), F.lit(0.0)).alias(col)
        best = tracks.select(*group, value).withColumn("_r", F.row_number().over(w)).where("_r <= 4")
        return best.groupBy(*group).agg(F.sum(col).alias(name), F.max(col).alias(f"{name}_max"))

    n = tracks.groupBy(*group).agg(F.count(F.lit(1)).alias("tracks"))
    out = n.join(top("score", "_s"), group).join(top("t_span", "_t"), group)
    # Weights of the quality.
    quality = F.col("_s") + 0.12 * F.col("_t") + 0.35 * F.col("_t_max") + 0.03 * F.col("tracks")
    return out.select(*group, "tracks", quality.alias("quality"))


def track_stage_stats(tracks: DataFrame, group: Sequence[str] = ("stage",)) -> DataFrame:
    """Count, medians of span, length and probability, and the tenth percentile of probability."""
    group = list(group)
    out = tracks.groupBy(*group).agg(F.count(F.lit(1)).alias("tracks"))
    for col, probs in (
        ("t_span", {"span_median": 0.5}),
        ("length_px", {"length_median": 0.5}),
        ("mean_prob", {"prob_median": 0.5, "prob_p10": 0.1}),
    ):
        out = out.join(exact_percentiles(tracks, group, col, probs), group, "left")
    return out


def select_passes(
    tracks: DataFrame, max_tracks: int = 12, min_mean_prob: float = 0.12, disable_fallback: bool = False
) -> DataFrame:
    """Which passes (strict, recover, rescue) of each kymograph are used.

    ``tracks`` carries ``mode``.  A good strict pass is used alone; otherwise a
    looser pass joins unless it floods without being better, or is too unsure.
    ``disable_fallback`` leaves the strict pass alone in every case.
    """
    group = ["kymo", "mode"]
    stats = track_set_quality(tracks, group).join(
        exact_percentiles(tracks, group, "mean_prob", {"median_prob": 0.5}), group, "left"
    )
    strict = stats.where("mode = 'strict'").select(
        "kymo",
        F.col("tracks").alias("_n"),
        F.col("quality").alias("_q"),
        F.col("median_prob").alias("_p"),
    )
    # Targets and factors of the choice.
    target = max(8, min(24, round(0.16 * max(24, max_tracks))))
    alone = (F.col("_n") >= target) & (F.col("_p") >= max(0.11, 0.85 * min_mean_prob))
    limit = F.greatest(F.col("_n") + 24, F.bround(1.6 * F.col("_n")))
    floods = (F.col("tracks") > limit) & (F.col("quality") <= 1.2 * F.col("_q"))
    floor = F.greatest(F.lit(0.85 * min_mean_prob), 0.75 * F.col("_p"), F.lit(0.08))
    usable = ~floods & (F.col("median_prob") >= floor)
    out = stats.join(strict, "kymo", "left")
    used = F.when(F.col("mode") == "strict", F.lit(True)).otherwise(
        F.col("_n").isNull() | (~F.coalesce(alone, F.lit(False)) & usable)
    )
    if disable_fallback:
        used = F.col("mode") == "strict"
    return out.select("kymo", "mode", "tracks", "quality", "median_prob", used.alias("used"))


def union_of_passes(passes: Mapping[str, DataFrame]) -> DataFrame:
    """Tracks of several passes in one table that tells the pass in ``mode``."""
    named = [tracks.withColumn("mode", F.lit(mode)) for mode, tracks in passes.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def _sized(nodes: DataFrame) -> DataFrame:
    """Number of frames and both ends of each track."""
    return nodes.groupBy(*ID).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("x", "t").alias("first"), F.max_by("x", "t").alias("last")
    )


def _near_pairs(
    a: DataFrame, b: DataFrame, reach: float, enough: Callable[[Column, Column], Column], extra: Column | None = None
) -> DataFrame:
    """Pairs of tracks that are closer than ``reach`` on enough shared frames, with both tracks' sizes and ends.

    ``enough`` gives the least number of close frames from the two sizes.  Close frames are counted per pair
    as they are found, so a pair is one row for each task, and most pairs end here.
    """
    left = a.withColumn("_c", F.floor(F.col("x") / reach)).alias("a")
    right = b.withColumn("_c", F.explode(F.array(*[F.floor(F.col("x") / reach) + k for k in (-1, 0, 1)]))).alias("b")
    cond = F.abs(F.col("a.x") - F.col("b.x")) <= reach
    for c in ("kymo", "t", "_c"):
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    if extra is not None:
        cond = cond & extra
    met = left.join(right, cond).select(F.col("a.kymo").alias("kymo"), F.col("a.track").alias("track"), F.col("b.track").alias("other"))
    close = met.groupBy("kymo", "track", "other").agg(F.count(F.lit(1)).alias("_close"))
    sizes = _sized(a).withColumnsRenamed({"n": "_an", "first": "_afirst", "last": "_alast"})
    others = _sized(b).withColumnsRenamed({"track": "other", "n": "_bn", "first": "_bfirst", "last": "_blast"})
    found = close.join(sizes, ID).join(others, ["kymo", "other"])
    return found.where(F.col("_close") >= enough(F.col("_an"), F.col("_bn"))).drop("_close")


def overlap_stats(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Distance and overlap of track pairs (of ``_near_pairs``) over their shared frames.

    overlap = shared / shorter, union = shared / all frames of both.
    """
    known = ["_an", "_bn", "_afirst", "_bfirst", "_alast", "_blast"]

    other = b.select("kymo", F.col("track").alias("other"), "t", F.col("x").alias("_ox"))
    dx = F.abs(F.col("x") - F.col("_ox"))
    shared = (
        pairs.join(a.select(*ID, "t", "x"), ID)
        .join(other, ["kymo", "other", "t"])
        .groupBy(*ID, "other", *known)
        # At most one value per frame of the movie.
        .agg(F.count(F.lit(1)).alias("shared"), F.avg(dx).alias("mean_dx"), F.percentile(dx, F.lit(0.9)).alias("p90_dx"))
    )
    return _judged(shared)


def _judged(shared: DataFrame) -> DataFrame:
    return shared.select(
        *ID,
        "other",
        "mean_dx",
        "p90_dx",
        (F.col("shared") / F.least("_an", "_bn")).alias("overlap"),
        (F.col("shared") / (F.col("_an") + F.col("_bn") - F.col("shared"))).alias("overlap_union"),
        F.abs(F.col("_afirst") - F.col("_bfirst")).alias("start_dx"),
        F.abs(F.col("_alast") - F.col("_blast")).alias("end_dx"),
    )


def _crowded(*nodes: DataFrame) -> DataFrame:
    """Kymographs with more than ``WHOLE`` nodes: at most one row for each ``WHOLE`` nodes."""
    kymos = reduce(DataFrame.unionByName, [n.select("kymo") for n in nodes]).where(F.col("kymo").isNotNull())
    return stage(kymos.groupBy("kymo").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > WHOLE).select("kymo"), "crowded")


def _packed(nodes: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """One row per track with its frames and places as lists, dealt by kymograph.

    ``_odd`` tells that frames repeat or that something is null. With ``tracks``, those that have a row there,
    with the lowest and the highest score; each of several rows counts the nodes anew.
    """
    rows = nodes.select(*ID, "t", "x")
    node = F.lit(True)
    if tracks is not None:
        named = tracks.select(*ID, "score", F.lit(True).alias("_named"))
        rows, node = rows.unionByName(named, allowMissingColumns=True), F.col("_named").isNull()
    measures = [
        F.collect_list(F.when(node, F.struct("t", "x"))).alias("_nodes"),
        F.min_by("x", "t").alias("_first"),
        F.max_by("x", "t").alias("_last"),
        *[f(c).alias(f"_{side}_{c}") for c in ("t", "x") for side, f in (("least", F.min), ("most", F.max))],
    ]
    if tracks is not None:
        measures += [F.count("_named").alias("_rows"), F.min("score").alias("_low"), F.max("score").alias("_high")]
    out = rows.where(F.col("track").isNotNull()).repartition("kymo").groupBy(*ID).agg(*measures)
    out = out.where("size(_nodes) > 0" if tracks is None else "size(_nodes) > 0 AND _rows > 0")
    odd = (F.size(F.array_distinct("_nodes.t")) < F.size("_nodes")) | F.exists("_nodes", lambda n: n["t"].isNull() | n["x"].isNull())
    return out.withColumns(
        {
            "_ts": F.col("_nodes.t"),
            "_xs": F.col("_nodes.x"),
            "_odd": odd,
            "_n": F.size("_nodes") * (F.lit(1) if tracks is None else F.col("_rows")),
        }
    )


def _packed_stats(
    a: DataFrame, b: DataFrame, reach: float, least: Callable[[Column, Column], Column], extra: Column | None = None
) -> DataFrame:
    """As ``overlap_stats``, of ``_packed`` tracks: a pair meets once and is measured where it meets.

    Left out are pairs that share fewer frames than ``least`` gives from the two sizes, or that can't be closer than ``reach``.
    """
    a, b = a.alias("a"), b.alias("b")
    odd = F.col("a._odd") | F.col("b._odd")
    both = F.array_intersect("a._ts", "b._ts")
    cond = (F.col("a.kymo") == F.col("b.kymo")) & (F.col("a._least_t") <= F.col("b._most_t")) & (F.col("b._least_t") <= F.col("a._most_t"))
    cond = cond & (F.col("a._least_x") - F.col("b._most_x") <= reach) & (F.col("b._least_x") - F.col("a._most_x") <= reach)
    if extra is not None:
        cond = cond & extra
    cond = cond & (odd | (F.size(both) >= F.greatest(F.lit(1.0), least(F.col("a._n"), F.col("b._n")) - 1e-6)))

    def place(side: str, t: Column) -> Column:
        return F.get(F.col(f"{side}._xs"), (F.array_position(F.col(f"{side}._ts"), t) - 1).cast("int"))

    plain = F.transform(both, lambda t: F.abs(place("a", t) - place("b", t)))
    each = F.transform(
        "a._nodes",
        lambda n: F.transform(F.filter("b._nodes", lambda m: m["t"] == n["t"]), lambda m: F.abs(n["x"] - m["x"])),
    )
    dx = F.sort_array(F.when(odd, F.flatten(each)).otherwise(plain))

    def measured(d: Column) -> Column:
        # Null places go first.
        empty = F.when(odd, F.size(F.filter(d, lambda v: v.isNull()))).otherwise(0)
        known = F.size(d) - empty
        at = 0.9 * (known - 1)
        low, high = F.get(d, (empty + F.floor(at)).cast("int")), F.get(d, (empty + F.ceil(at)).cast("int"))
        # The built-in percentile weighs the two neighbours in this way.
        between = F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
        total = F.aggregate(d, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
        return F.struct(
            F.size(d).alias("shared"),
            F.when(known > 0, total / known).alias("mean_dx"),
            F.when(known > 0, between).alias("p90_dx"),
        )

    # Made by a generator, so that what asks for these columns doesn't work them out again.
    stats = a.join(b, cond).select(
        F.col("a.kymo").alias("kymo"),
        F.col("a.track").alias("track"),
        F.col("b.track").alias("other"),
        *[F.col(f"{side}._{c}").alias(f"_{side}{c}") for side in ("a", "b") for c in ("n", "first", "last")],
        F.inline(F.transform(F.array(dx), measured)),
    )
    return _judged(stats.where(F.col("shared") > 0))


def match_tracks(a: DataFrame, b: DataFrame, p: FinderParams = FinderParams()) -> DataFrame:
    """Pairs (track, other) of two node tables that describe the same path."""
    def asked(n: Column, m: Column) -> Column:
        return F.least(p.match_overlap * F.least(n, m), p.loose_union / (1 + p.loose_union) * (n + m))

    def enough(n: Column, m: Column) -> Column:
        # Both rules limit the ninetieth percentile, so nine tenths of the frames that they ask for are close.
        return 0.9 * (asked(n, m) - 1)

    a, b = a.select(*ID, "t", "x"), b.select(*ID, "t", "x")
    reach = max(p.match_p90_dx, p.loose_p90_dx)
    crowded = _crowded(a, b)
    if crowded.isEmpty():
        s = _packed_stats(_packed(a), _packed(b), reach, asked)
    else:
        (a, b), (whole_a, whole_b) = [[n.join(F.broadcast(crowded), "kymo", how) for n in (a, b)] for how in ("left_semi", "left_anti")]
        whole = _packed_stats(_packed(whole_a), _packed(whole_b), reach, asked)
        s = overlap_stats(_near_pairs(a, b, reach, enough), a, b).unionByName(whole)
    tight = (F.col("overlap") >= p.match_overlap) & (F.col("mean_dx") <= p.match_mean_dx) & (F.col("p90_dx") <= p.match_p90_dx)
    loose = (
        (F.col("overlap_union") >= p.loose_union)
        & (F.col("start_dx") <= p.loose_end_dx)
        & (F.col("end_dx") <= p.loose_end_dx)
        & (F.col("p90_dx") <= p.loose_p90_dx)
    )
    return s.where(tight | loose)


def stage_fates(premerge: DataFrame, post_merge: DataFrame, post_extend: DataFrame, final: DataFrame) -> DataFrame:
    """For each track before merging: the stage at which nothing matches it any more."""
    # All stages in one pass: the other track's id tells its stage.
    stages = {"_m": post_merge, "_e": post_extend, "_f": final}
    others = reduce(
        DataFrame.unionByName,
        [n.select("kymo", F.concat(F.lit(name), F.col("track").cast("string")).alias("track"), "t", "x") for name, n in stages.items()],
    )
    hits = match_tracks(premerge.select(*ID, "t", "x"), others)
    hits = hits.groupBy(*ID).agg(*[F.max(F.when(F.col("other").startswith(name), F.lit(True))).alias(name) for name in stages])
    out = premerge.select(*ID).distinct().join(hits, ID, "left")
    # Names of the stages.
    fate = (
        F.when(F.col("_m").isNull(), "lost_before_post_merge")
        .when(F.col("_e").isNull(), "lost_before_post_extend")
        .when(F.col("_f").isNull(), "lost_before_final")
        .otherwise("survived_final")
    )
    return out.select(*ID, fate.alias("fate"))


def dedupe_tracks(
    nodes: DataFrame, tracks: DataFrame, max_dx: float = FinderParams.strict_dx, min_overlap: float = FinderParams.strict_overlap
) -> DataFrame:
    """Tracks without those that a better one (score, then smaller id) duplicates.

    One round: a track is dropped by any better duplicate, itself dropped or not,
    so the result does not depend on the order.
    """
    def better(b: str, a: str) -> Column:
        tie = (F.col(f"b.{b}") == F.col(f"a.{a}")) & (F.col("b.track") < F.col("a.track"))
        return (F.col(f"b.{b}") > F.col(f"a.{a}")) | tie

    def asked(n: Column, m: Column) -> Column:
        return min_overlap * F.least(n, m)

    def whole(nodes: DataFrame, tracks: DataFrame) -> DataFrame:
        each = _packed(nodes, tracks)
        # If the mean is small, some shared frame is as close.
        return _packed_stats(each, each, max_dx, asked, better("_high", "_low"))

    nodes, scores = nodes.select(*ID, "t", "x"), tracks.select(*ID, "score")
    crowded = _crowded(nodes)
    if crowded.isEmpty():
        stats = whole(nodes, scores)
    else:
        (many, some), (few, rest) = [[d.join(F.broadcast(crowded), "kymo", how) for d in (nodes, scores)] for how in ("left_semi", "left_anti")]
        ranked = many.join(some, ID)
        # If the mean is small, half of the shared frames are within twice of it.
        pairs = _near_pairs(ranked, ranked, 2 * max_dx, lambda n, m: 0.5 * asked(n, m), better("score", "score"))
        stats = overlap_stats(pairs, many, many).unionByName(whole(few, rest))
    worse = stats.where((F.col("mean_dx") <= max_dx) & (F.col("overlap") >= min_overlap)).select(*ID).distinct()
    return tracks.join(worse, ID, "left_anti")


def merge_track_sets(
    sets: Sequence[tuple[DataFrame, DataFrame]],
    max_tracks: int | None = FinderParams.max_tracks,
    max_dx: float = FinderParams.dedupe_dx,
    min_overlap: float = FinderParams.dedupe_overlap,
) -> DataFrame:
    """Union of (tracks, nodes) sets, two rounds of duplicate removal, best ``max_tracks`` per kymograph.

    0 or None keeps all tracks.
    """
    # Track ids of the sets must not clash.
    tracks, nodes = sets[0]
    for t, n in sets[1:]:
        tracks, nodes = tracks.unionByName(t), nodes.unionByName(n)
    p = FinderParams()
    # Both rounds read nodes and tracks several times.
    tracks, nodes = stage(tracks, "tracks"), stage(nodes, "track-nodes")
    tracks = stage(dedupe_tracks(nodes, tracks, p.strict_dx, p.strict_overlap), "tracks")
    tracks = dedupe_tracks(nodes, tracks, max(0.2, max_dx), min(0.99, max(0.5, min_overlap)))
    w = W.partitionBy("kymo").orderBy(F.col("score").desc(), "track")
    ranked = tracks.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= max_tracks) if max_tracks else ranked


def path_mask(nodes: DataFrame, n_frames: int, width: int, radius: int = 1) -> DataFrame:
    """Kymograph cells (kymo, t, x) within ``radius`` columns of a path node."""
    x = F.bround("x").cast("int")
    cells = nodes.withColumn("t", F.col("t").cast("int")).where(F.col("t").between(0, n_frames - 1)).select(
        "kymo", "t", F.explode(F.sequence(x - radius, x + radius)).alias("x")
    )
    return cells.where(F.col("x").between(0, width - 1)).distinct()


def link_fragments(
    nodes: DataFrame,
    probs: DataFrame,
    max_gap: int = 3,
    max_dx: float = 2.0,
    min_prob: float = 0.30,
    min_coverage: float = 0.70,
    embeddings: DataFrame | None = None,
    min_similarity: float = 0.18,
) -> DataFrame:
    """Links from the end of one track to the start of another, mutual best choice only.

    With ``embeddings`` (kymo, track, embedding) both tracks need one, of equal length
    and not zero, and a cosine similarity of at least ``min_similarity``.

    Between the two, the cells on the straight line must be probable enough:
    mean at least ``min_prob`` and a share of ``min_coverage`` above it; cells
    that are not in ``probs`` (kymo, t, x, p) count as 0.  Adjacent frames have
    no bridge.  The best partner has the smallest gap, then the smallest |dx|.
    """
    ends = nodes.groupBy(*ID).agg(
        F.min("t").alias("t0"), F.min_by("x", "t").alias("x0"), F.max("t").alias("t1"), F.max_by("x", "t").alias("x1")
    )
    tails = ends.select(
        "kymo",
        "track",
        "t1",
        "x1",
        F.explode(F.sequence(F.lit(1), F.lit(max_gap))).alias("gap"),
    ).withColumn("_t", F.col("t1") + F.col("gap")).withColumn("_c", F.floor(F.col("x1") / max_dx))
    heads = ends.select("kymo", F.col("track").alias("other"), F.col("t0").alias("_t"), "x0").withColumn(
        "_c", F.explode(F.array(*[F.floor(F.col("x0") / max_dx) + k for k in (-1, 0, 1)]))
    )
    cand = (
        tails.join(heads, ["kymo", "_t", "_c"])
        .withColumn("dx", F.abs(F.col("x1") - F.col("x0")))
        .where((F.col("dx") <= max_dx) & (F.col("track") != F.col("other")))
        .select("kymo", "track", "other", "t1", "x1", "x0", "gap", "dx")
    )
    step = F.explode(F.sequence(F.lit(1), F.col("gap") - 1))
    bridge = cand.where("gap > 1").withColumn("k", step).select(
        "kymo",
        "track",
        "other",
        (F.col("t1") + F.col("k")).alias("t"),
        F.bround(F.col("x1") + F.col("k") / F.col("gap") * (F.col("x0") - F.col("x1"))).cast("int").alias("x"),
    )
    p = F.coalesce("p", F.lit(0.0))
    judged = (
        bridge.join(probs.select("kymo", "t", "x", "p"), ["kymo", "t", "x"], "left")
        .groupBy("kymo", "track", "other")
        .agg(F.avg(p).alias("_mean"), F.avg((p >= min_prob).cast("double")).alias("_cover"))
        .where((F.col("_mean") >= min_prob) & (F.col("_cover") >= min_coverage))
    )
    ok = cand.join(judged.select("kymo", "track", "other", F.lit(True).alias("_ok")), ["kymo", "track", "other"], "left")
    ok = ok.where((F.col("gap") == 1) | F.col("_ok"))
    if embeddings is not None:
        ok = _alike(ok, embeddings, min_similarity)
    first = W.partitionBy("kymo", "track").orderBy("gap", "dx", "other")
    best = ok.withColumn("_a", F.row_number().over(first)).where("_a = 1")
    back = W.partitionBy("kymo", "other").orderBy("gap", "dx", "track")
    mine = ok.withColumn("_b", F.row_number().over(back)).where("_b = 1").select("kymo", "track", "other")
    return best.select("kymo", "track", "other", "gap", "dx").join(mine, ["kymo", "track", "other"], "left_semi")


def _alike(pairs: DataFrame, embeddings: DataFrame, least: float) -> DataFrame:
    """Pairs of tracks whose embeddings have a cosine similarity of at least ``least``."""
    one = embeddings.select("kymo", "track", F.col("embedding").cast("array<double>").alias("_u"))
    other = one.select("kymo", F.col("track").alias("other"), F.col("_u").alias("_v"))

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    out = pairs.join(one, ["kymo", "track"]).join(other, ["kymo", "other"]).where(F.size("_u") == F.size("_v"))
    norm = F.sqrt(dot("_u", "_u") * dot("_v", "_v"))
    return out.where((norm > 0) & (dot("_u", "_v") >= least * norm)).drop("_u", "_v")


def tracks_to_anchors(nodes: DataFrame, source: str = "finder") -> DataFrame:
    """Cleaned nodes as kymograph anchors of new trajectories, with their source."""
    return nodes.select(
        F.col("kymo").alias("roi"),
        F.col("track").alias("trajectory"),
        F.col("t").cast("int").alias("frame"),
        F.col("x").cast("double").alias("xk"),
        F.lit(source).alias("source"),
    )
