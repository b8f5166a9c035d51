"""Spelling variants: words within one edit of a much more frequent word, found in a trie of letter counts.

A word's letters fall in ``GROUPS`` groups; its vector says how many fall in each.  Words are arranged in a
trie by the count of the first group, then of the second, and so on.  One inserted, deleted or replaced
character changes the vector by at most one more in one group (surplus) and one less in one (deficit), so a
search goes down with a budget of one each; the words of the leaves it comes to are compared letter by letter.

The upper part of the trie is spread: a node of more than ``limit`` words is divided by its next count, and
what is left are subtrees of at most ``limit`` words (words of one whole vector beyond that are dealt into
blocks).  Only the divided nodes are known to every task: with ``limit`` growing as the number of words over
``MOST_NODES``, they are at most ``MOST_NODES`` in each level.  A word is sent to the subtrees that its budget
reaches, to one of two that see each other, and searched there depth first together with its batch.

Defined results: null text has no words; rows without an id lose no letters; an empty table, or one without a
word that is long and frequent enough, gives no rows; a word whose largest near words are equally frequent
takes the first in code-point order.  Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import U, give_back, mix, table
from trackloom.plans.stages import stage

MIN_CHARS, MIN_COUNT, FACTOR, ONE_IN = 7, 2, 10, 31
GROUPS = 12
#: Words of a subtree that one task builds, and the most divided nodes of a level that tasks are told of.
LIMIT, MOST_NODES = 8_192, 20_000
#: Words that search a subtree together, and words at a leaf.
_TOGETHER, _LEAF = 16_384, 8
#: Letters up to which words are compared as rows of a matrix.
_WIDE = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def worn(word: Column, doc_id: Column, one_in: int = ONE_IN) -> Column:
    """The word, without one letter where ``one_in`` divides the crc32 of id, colon and word."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def count_words(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    one_in: int = ONE_IN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    # A run that is too short stays too short, and a pattern that takes whole runs skips it.
    runs = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{min_chars},}}"), F.lit(0))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", _UPPER, _LOWER).alias("word")).select(worn(F.col("word"), F.col("id"), one_in).alias("word"))
    return rows.where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


class Letters:
    """Words as code points (all below 256), with their vectors."""

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.array([len(w) for w in words], np.int64)
        self.codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.end = np.cumsum(self.length)
        owner = np.repeat(np.arange(len(words)), self.length)
        cell = owner * GROUPS + self.codes % GROUPS
        self.counts = np.bincount(cell, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)

    def matrix(self, backwards: bool) -> np.ndarray:
        """One row of letters for each word, from its first or its last letter on; wide words are cut."""
        start, width = self.end - self.length, min(_WIDE, int(self.length.max(initial=0)))
        place = np.arange(width)[None, :]
        at = self.end[:, None] - 1 - place if backwards else start[:, None] + place
        inside = place < self.length[:, None]
        return np.where(inside, self.codes[np.where(inside, at, 0)], 0) if len(self.codes) else np.zeros((len(self.words), width), np.uint8)


_ROOT = U(0x9E3779B97F4A7C15)


def _child(node: np.ndarray, count: np.ndarray) -> np.ndarray:
    return mix(node * U(0xD1342543DE82EF95) + (count + 1).astype(U), 61)


def _paths(x: Letters) -> np.ndarray:
    """Names of the nodes on each word's way, from the root to its whole vector."""
    out = np.empty((len(x.words), GROUPS + 1), U)
    out[:, 0] = _ROOT
    for level in range(GROUPS):
        out[:, level + 1] = _child(out[:, level], x.counts[:, level])
    return out


def _divided(words: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the nodes with more than ``limit`` words, in order, and how many words each has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, n = np.unique(_paths(Letters(b.column("word").to_pylist())), return_counts=True)
            yield table({"node": names.view(np.int64), "n": n}, {"node": pa.int64(), "n": pa.int64()})

    rows = words.select("word").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    # At most MOST_NODES of each level by the choice of ``limit``.
    found = sorted((r.node & (2**64 - 1), r.n) for r in rows.where(F.col("n") > limit).collect())
    return np.array([k for k, _ in found], U), np.array([n for _, n in found], np.int64)


def _blocks(node: np.ndarray, open_nodes: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    """Into how many blocks the words of each node are dealt: one, but for a large node of the lowest level."""
    if not len(open_nodes):
        return np.ones(len(node), np.int64)
    at = np.minimum(np.searchsorted(open_nodes, node), len(open_nodes) - 1)
    return np.where(open_nodes[at] == node, -(-sizes[at] // limit), 1)


def _is_open(node: np.ndarray, open_nodes: np.ndarray) -> np.ndarray:
    if not len(open_nodes):
        return np.zeros(len(node), bool)
    return open_nodes[np.minimum(np.searchsorted(open_nodes, node), len(open_nodes) - 1)] == node


def routes(x: Letters, open_nodes: np.ndarray, sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, shard, side, depth): side 0 is a word's own subtree, side 1 the others it has to search.

    Of two words whose ways part in the upper part, the one with the smaller count where they first part
    searches the subtree of the other.  Words of a lowest node that has blocks also search its blocks.
    """
    word = np.arange(len(x.words))
    node = np.full(len(word), _ROOT)
    more, less, own = np.ones(len(word), bool), np.ones(len(word), bool), np.ones(len(word), bool)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for level in range(GROUPS + 1):
        going = _is_open(node, open_nodes) if level < GROUPS else np.zeros(len(node), bool)
        out.append((word[~going], node[~going], own[~going], np.full(int((~going).sum()), level)))
        word, node, more, less, own = word[going], node[going], more[going], less[going], own[going]
        if not len(word):
            break
        count = x.counts[word, level]
        same = (word, _child(node, count), more, less, own)
        up = more
        higher = (word[up], _child(node[up], count[up] + 1), more[up] & False, less[up], own[up] & False)
        # The first difference is never downwards: the other word comes to this one then.
        down = less & ~own & (count > 0)
        lower = (word[down], _child(node[down], count[down] - 1), more[down], less[down] & False, own[down])
        word, node, more, less, own = (np.concatenate(p) for p in zip(same, higher, lower))
    word, node, own, depth = (np.concatenate(p) for p in zip(*out))
    n_blocks = _blocks(node, open_nodes, sizes, limit)
    many = n_blocks > 1
    home = own & ~many
    parts = [(word[~many], node[~many], np.where(home[~many], 0, 1), depth[~many])]
    if many.any():
        w, v, o, z, n = word[many], node[many], own[many], depth[many], n_blocks[many]
        each = np.repeat(np.arange(len(w)), n)
        block = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        mine = (mix(_word_hash(x)[w], 62) % n.astype(U)).astype(np.int64)[each]
        # A word of the node itself is at home in one block and searches those behind it.
        keep = ~o[each] | (block >= mine)
        side = np.where(o[each] & (block == mine), 0, 1)
        name = mix(v[each] + block.astype(U), 63)
        parts.append((w[each][keep], name[keep], side[keep], z[each][keep]))
    word, shard, side, depth = (np.concatenate(p) for p in zip(*parts))
    return word, shard, side.astype(np.int8), depth.astype(np.int8)


def _word_hash(x: Letters) -> np.ndarray:
    place = np.arange(len(x.codes)) - np.repeat(x.end - x.length, x.length)
    mixed = mix(x.codes.astype(U) + (place.astype(U) << U(8)), 64)
    sums = np.append(U(0), np.cumsum(mixed))
    return sums[x.end] - sums[x.end - x.length]


class Subtree:
    """The words of one subtree in the order of their vectors: a node is a stretch with equal counts so far."""

    def __init__(self, words: list[str], n: np.ndarray, depth: int):
        x = Letters(words)
        order = np.lexsort(x.counts[:, ::-1].T)
        self.x = Letters([words[i] for i in order])
        self.n, self.depth = n[order], depth

    def candidates(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(searching word, word here) with vectors one surplus and one deficit apart at most."""
        here = self.x.counts
        # Down to this subtree nothing is compared again: its words share these counts.
        base = here[0, : self.depth] - counts[:, : self.depth]
        more, less = 1 - np.maximum(base, 0).sum(axis=1), 1 - np.maximum(-base, 0).sum(axis=1)
        found_q, found_w = [], []
        q = np.flatnonzero((more >= 0) & (less >= 0))
        todo = [(0, len(here), self.depth, q, more[q], less[q])]
        while todo:
            lo, hi, level, q, more, less = todo.pop()
            if not len(q):
                continue
            if hi - lo <= _LEAF or level == GROUPS:
                each = max(1, (1 << 18) // (hi - lo))
                for i in range(0, len(q), each):
                    part = q[i : i + each]
                    apart = here[None, lo:hi, level:] - counts[part, None, level:]
                    ok = np.maximum(apart, 0).sum(axis=2) <= more[i : i + each, None]
                    ok &= np.maximum(-apart, 0).sum(axis=2) <= less[i : i + each, None]
                    a, b = np.nonzero(ok)
                    found_q.append(part[a])
                    found_w.append(b + lo)
                continue
            own = counts[q, level]
            cuts = np.append(lo, np.flatnonzero(here[lo + 1 : hi, level] != here[lo : hi - 1, level]) + lo + 1)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), hi]):
                apart = here[a, level] - own
                go = (apart == 0) | ((apart == 1) & (more > 0)) | ((apart == -1) & (less > 0))
                todo.append((a, b, level + 1, q[go], more[go] - (apart[go] == 1), less[go] - (apart[go] == -1)))
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return cat(found_q), cat(found_w)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character turns ``a`` into ``b``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[at + (len(a) == len(b)) :] == long[at + 1 :]


def near(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    """Which pairs of words ``i`` of ``a`` and ``j`` of ``b`` are exactly one edit apart."""
    out = np.zeros(len(i), bool)
    x, y = a.length[i], b.length[j]
    least, most = np.minimum(x, y), np.maximum(x, y)
    wide = most > _WIDE
    for k in np.flatnonzero(wide):
        out[k] = one_edit(a.words[i[k]], b.words[j[k]])
    todo = np.flatnonzero(~wide & (most - least <= 1))
    sides = [(a.matrix(back), b.matrix(back)) for back in (False, True)] if len(todo) else []
    for s in range(0, len(todo), 1 << 15):
        k = todo[s : s + (1 << 15)]
        same = np.zeros(len(k), np.int64)
        for left, right in sides:
            width = min(left.shape[1], right.shape[1])
            differ = left[i[k], :width] != right[j[k], :width]
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(len(k), np.int64)
            same += np.minimum(first, least[k])
        equal = (same >= 2 * most[k]) & (least[k] == most[k])
        out[k] = (same >= most[k] - 1) & ~equal
    return out


_RESULT = "word string, n_near long, best_n long, best string"
_RESULT_TYPES = {"word": pa.string(), "n_near": pa.int64(), "best_n": pa.int64(), "best": pa.string()}


def _credit(pairs: list[tuple[list[str], np.ndarray, np.ndarray, list[str], np.ndarray]]) -> pa.RecordBatch:
    """For each word, how many near words it has among the pairs and the most frequent of them."""
    out: dict[str, tuple[int, int, str]] = {}
    for words, i, n, others, j in pairs:
        for w, m, o in zip([words[k] for k in i], n.tolist(), [others[k] for k in j]):
            seen = out.get(w)
            if seen is None:
                out[w] = (1, m, o)
            else:
                out[w] = (seen[0] + 1, *((m, o) if (-m, o) < (-seen[1], seen[2]) else seen[1:]))
    return table({"word": list(out), "n_near": [x[0] for x in out.values()], "best_n": [x[1] for x in out.values()], "best": [x[2] for x in out.values()]}, _RESULT_TYPES)


def near_words(words: DataFrame, n_words: int, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words; rows of one word are to be combined."""
    limit = max(limit, -(-n_words // MOST_NODES))
    context = words.sparkSession.sparkContext
    shared = context.broadcast(_divided(words, limit))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, shard, side, depth = routes(Letters(b.column("word").to_pylist()), *shared.value, limit)
            picked = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.view(np.int64)), pa.array(side), pa.array(depth), picked.column("word"), picked.column("n")], names=["shard", "side", "depth", "word", "n"]
            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, home, guests, tree = None, [], [], None

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """Let the gathered words search the subtree; it is built when its first guests come or it ends."""
            nonlocal home, guests, tree
            if tree is None and home:
                own = pa.Table.from_batches(home)
                tree = Subtree(own.column("word").to_pylist(), own.column("n").to_numpy(), own.column("depth")[0].as_py())
                home = []
                x, n = tree.x, tree.n
                i, j = tree.candidates(x.counts)
                i, j = i[i < j], j[i < j]
                ok = near(x, i, x, j)
                i, j = i[ok], j[ok]
                if len(i):
                    yield _credit([(x.words, i, n[j], x.words, j), (x.words, j, n[i], x.words, i)])
            if tree is not None and guests:
                come = pa.Table.from_batches(guests)
                x, n = Letters(come.column("word").to_pylist()), come.column("n").to_numpy()
                i, j = tree.candidates(x.counts)
                ok = near(x, i, tree.x, j)
                i, j = i[ok], j[ok]
                if len(i):
                    yield _credit([(x.words, i, tree.n[j], tree.x.words, j), (tree.x.words, j, n[i], x.words, i)])
            guests = []
            if last:
                home, tree = [], None

        for b in batches:
            if not b.num_rows:
                continue
            name = b.column("shard").to_numpy()
            side = b.column("side").to_numpy()
            cuts = np.flatnonzero((name[1:] != name[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if name[lo] != shard:
                    yield from flush(True)
                    shard = name[lo]
                if side[lo] == 0:
                    home.append(b.slice(lo, hi - lo))
                elif home or tree is not None:  # else no word lives here
                    guests.append(b.slice(lo, hi - lo))
                    if sum(g.num_rows for g in guests) >= _TOGETHER:
                        yield from flush(False)
        yield from flush(True)
        give_back()

    sent = words.mapInArrow(send, "shard long, side byte, depth byte, word string, n long")
    return sent.repartition("shard").sortWithinPartitions("shard", "side").mapInArrow(search, _RESULT)


def _roots(forms: DataFrame, most: int, factor: int) -> DataFrame:
    """(word, root) for each word with a form: forms of forms, the way doubling each time."""
    longest = 1
    while factor ** (longest + 1) <= most:  # each form is ``factor`` times as frequent at least
        longest += 1
    now, steps = forms.select("word", F.col("form").alias("root")), 1
    while steps < longest:
        next_ = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        now = stage(now.join(next_, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root")), "spelling-roots")
        steps *= 2
    return now


def spelling_variants(words: DataFrame, factor: int = FACTOR, limit: int = LIMIT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of counted words (word, n), each of which is one row.

    ``form`` is the most frequent near word if it is at least ``factor`` times as frequent, else null.
    """
    if factor < 2:
        raise ValueError("factor: at least 2")
    words = stage(words.select("word", "n"), "spelling-words")
    size = words.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("most")).first()
    found = near_words(words, size.n, limit).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("form"))).alias("_b")
    )
    best_n = -F.col("_b.m")
    good = best_n >= factor * F.col("n")
    out = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("_b.form")).alias("form"), F.when(good, best_n).alias("form_n")
    )
    out = stage(out, "spelling-forms")
    ends = _roots(out.where("form is not null"), size.most or 1, factor)
    return out.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
