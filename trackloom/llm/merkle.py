"""Merkle manifest of a data set: a leaf per row, a tree per source, one tree over the sources.

A leaf is the digest of a row's fields.  In a tree, nodes are numbered from 0 in every level; ``arity``
consecutive ones are a run and become the digest of their digests, until one node is left.  A level is
joined with itself once for each slot offset: a node's siblings have its number with the slot moved on, so
each join is an equijoin on (tree, number) and a hot tree spreads over all tasks.  Slot-zero rows then hold
their whole run and emit the parent.  Going down again, a node's proof is its own siblings and its parent's.

Defined results: a null field is ``-`` in a leaf, and a null source is a tree of its own, before all others;
a null id comes first in its tree; rows that repeat an id follow in the order of their leaves; a lone leaf
is its tree's root and the proof of a single row is empty; an empty table has no rows.  Only the named
columns of the input are read, and the result has its own, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.ordered import laid_out, numbered
from trackloom.plans.stages import stage

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(fields: Sequence[Column]) -> Column:
    """Digest of a row: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(F.concat(*parts))


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (tree, number, n, hash) with the digests to the left and to the right of each in its run."""
    slot = F.col("number") % arity
    rows = nodes.select("tree", "number", "n", "hash", slot.alias("slot"))
    for d in range(1, arity):
        other = nodes.select(F.col("tree").alias("_t"), F.col("number").alias("_m"), F.col("hash").alias(f"_h{d}"))
        # The slot d places on, in the same run; the last run may not have it.
        place = F.col("number") - F.col("slot") + (F.col("slot") + d) % arity
        rows = rows.join(other, (F.col("tree") == F.col("_t")) & (place == F.col("_m")), "left").drop("_t", "_m")
    # In order of slots, those before the node's own are at the end of the offsets.
    after = [F.when(F.col("slot") + d < arity, F.col(f"_h{d}")) for d in range(1, arity)]
    before = [F.when(F.col("slot") + d >= arity, F.col(f"_h{d}")) for d in range(1, arity)]
    text = lambda parts: F.concat(*[F.coalesce(p, F.lit("")) for p in parts], F.lit(""))
    return rows.select("tree", "number", "n", "hash", text(before).alias("left"), text(after).alias("right"))


def _tree(nodes: DataFrame, arity: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Paths (tree, number, path) of the lowest level, and the roots (tree, hash).

    ``nodes``: (tree, number, n, hash), n the number of nodes of the tree in this level.  ``path`` has the
    digests beside each node on the way up.  Every level is a stored table; there are as many as the
    largest tree is high, and a tree that has come to its root takes no further part.
    """
    levels, roots = [], [nodes.where("n = 1").select("tree", "hash")]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        level = stage(_siblings(nodes.where("n > 1"), arity), name)
        levels.append(level)
        nodes = level.where(F.col("number") % arity == 0).select(
            "tree",
            F.floor(F.col("number") / arity).alias("number"),
            F.ceil(F.col("n") / arity).alias("n"),
            digest(F.concat("left", "hash", "right")).alias("hash"),
        )
        roots.append(nodes.where("n = 1").select("tree", "hash"))
        most = -(-most // arity)
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    step = F.struct("left", "right")
    paths = None
    for level in reversed(levels):
        own = level.select("tree", "number", F.array(step).alias("path"))
        if paths is not None:
            above = paths.select(F.col("tree").alias("_t"), F.col("number").alias("_m"), F.col("path").alias("_p"))
            met = own.join(above, (F.col("tree") == F.col("_t")) & (F.floor(F.col("number") / arity) == F.col("_m")), "left")
            own = met.select("tree", "number", F.concat("path", F.coalesce("_p", F.slice("path", 1, 0))).alias("path"))
        paths = own
    if paths is None:
        paths = nodes.where("false").select("tree", "number", F.array(F.struct(F.lit("").alias("left"), F.lit("").alias("right"))).alias("path"))
    return paths, found


def manifest(
    rows: DataFrame,
    tampered: Column | None = None,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    source_col: str = "source",
    arity: int = ARITY,
) -> DataFrame:
    """(id, leaf, tampered_leaf, subroot, root, proof, path) of every row.

    ``path`` holds the digests to the left and right of the way from the leaf to the root.  ``tampered`` is
    an expression of the row's leaf as it is found later (``leaf_of`` of changed fields; null: unchanged).
    """
    if arity < 2:
        raise ValueError("arity: at least 2")
    leaf = leaf_of([F.col(f"`{c}`") for c in fields])
    found = tampered if tampered is not None else F.lit(None).cast("string")
    leaves = rows.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        leaf.alias("leaf"),
        found.alias("tampered_leaf"),
    )
    leaves = stage(leaves, "manifest-leaves")
    laid = laid_out(leaves, ["source"], ["id", "leaf"], "manifest-order")

    # Sources by rank: null first, then by their bytes.
    sources = laid_out(leaves.select("source").distinct(), [], ["source"], "manifest-sources")
    sources = stage(numbered(sources, [], "tree", "n_trees"), "manifest-trees")
    named = sources.select(F.col("source").alias("_s"), "tree", "n_trees")
    placed = numbered(laid, ["source"], "number", "n").join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    placed = stage(placed, "manifest-places")

    paths, subroots = _tree(placed.select("tree", "number", "n", F.col("leaf").alias("hash")), arity, "manifest-level")
    subroots = stage(subroots, "manifest-subroots")
    top = subroots.join(named.select("tree", "n_trees"), "tree")
    top = top.select(F.lit(0).alias("_top"), F.col("tree").alias("number"), F.col("n_trees").alias("n"), "hash")
    over, root = _tree(top.withColumnRenamed("_top", "tree"), arity, "manifest-top")
    # The root is one digest, or none of an empty table.
    top_hash = (root.first() or [None, None])[1]
    above = over.select(F.col("number").alias("tree"), F.col("path").alias("_above"))
    above = subroots.join(above, "tree", "left").select("tree", F.col("hash").alias("subroot"), F.lit(top_hash).cast("string").alias("root"), "_above")
    above = stage(above, "manifest-above")
    ways = paths.withColumnsRenamed({"tree": "_t", "number": "_m"})
    out = placed.join(ways, (F.col("tree") == F.col("_t")) & (F.col("number") == F.col("_m")), "left").join(above, "tree")
    none = F.array().cast("array<struct<left:string,right:string>>")
    path = F.concat(F.coalesce("path", none), F.coalesce("_above", none))
    out = out.select("id", "leaf", "tampered_leaf", "subroot", "root", path.alias("path"))
    beside = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return out.select("id", "leaf", "tampered_leaf", "subroot", "root", digest(beside).alias("proof"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the digests beside its way up."""
    return F.aggregate(path, leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def verified(found: DataFrame) -> DataFrame:
    """A manifest with the root that the leaves found later give, and whether it is the root."""
    now = folded(F.coalesce("tampered_leaf", "leaf"), F.col("path"))
    out = found.withColumn("folded_root", now).drop("path", "tampered_leaf")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
