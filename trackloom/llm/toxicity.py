"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words.

A word's input is its own vector (of the words seen often enough in training; one vector for all others)
beside the mean vector of its character n-grams, so that unseen spellings count by their parts.  Two gated
recurrent layers read a window in both directions, attention weighs their states, and one unit scores the
sum.  All overlapping windows of a text are scored; the text's score is that of its highest window.

The network is trained by numpy in one task on a bounded sample: at most ``most`` documents of each label,
and of each at most ``TRAIN_WINDOWS`` windows, evenly spaced.  In training a document, too, is judged by its
highest windows.  The model is a few megabytes at most whatever the input is.

Defined results: null, empty and wordless texts score the share of label 1 among the training documents (0
without any); repeated rows are scored row by row; labels that repeat an id count once, as 1 if any is 1;
null labels and labels without a document aren't used; with no training document of one of the labels every
text scores that share.  Only the named columns are read and the result has its own, so no name can clash.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.words import ALNUM, U, Words, give_back, mix, slices, table, utf8, words_of

WINDOW, STRIDE = 48, 32
#: Documents of each label that are trained on, windows of each, and passes over them.
TRAIN_DOCS, TRAIN_WINDOWS, EPOCHS = 3_000, 16, 8
#: Documents of one step, and steps at least (more passes over a small sample).
BATCH, LEAST_STEPS = 32, 320
WORD_SIZE, CHAR_SIZE, STATE, ATTENTION = 8, 16, 8, 8
CHAR_CELLS = 1 << 14
CHAR_LENGTHS = (3, 4, 5)
#: A word has a vector of its own if it occurs in as many training documents.
LEAST_DOCS = 5
THRESHOLD = 0.7

F32 = np.float32


def place_windows(n_words: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, length) of all windows: every ``stride`` words, until one reaches the end."""
    count = np.where(n_words > 0, 1 + np.maximum(0, -(-(n_words - window) // stride)), 0)
    doc = np.repeat(np.arange(len(n_words)), count)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * stride
    return doc, start, np.minimum(window, n_words[doc] - start)


def char_cells(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the character n-grams (of the bytes, with both ends marked) of the chosen words, and where each word's begin."""
    start, end = words.start[chosen], words.end[chosen]
    size = end - start + 2
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(chosen)), size)
    place = np.arange(len(owner)) - first[owner]
    inner = (place > 0) & (place < size[owner] - 1)
    raw = np.where(place == 0, 2, 3).astype(np.uint8)
    raw[inner] = words.data[(start[owner] + place - 1)[inner]]
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(U)
    left = size[owner] - place
    cells, owners = [], []
    h = np.zeros(len(raw), U)
    for t in range(max(CHAR_LENGTHS)):
        h[: len(raw) - t] = h[: len(raw) - t] * U(0x100000001B3) + raw[t:] + U(1)
        if t + 1 in CHAR_LENGTHS:
            whole = left > t
            cells.append((mix(h[whole], t) % U(CHAR_CELLS)).astype(np.int32))
            owners.append(owner[whole])
    cell, owner = np.concatenate(cells), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return cell[order], np.searchsorted(owner[order], np.arange(len(chosen)))


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, starts, axis=0) if len(starts) else np.zeros((0, rows.shape[1]), rows.dtype)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(1) / (F32(1) + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters by name, scores of windows, and their gradients."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by=None: rng.normal(0, (by or shape[0]) ** -0.5, shape).astype(F32)
        size = WORD_SIZE + CHAR_SIZE
        self.vocabulary = vocabulary
        self.p = {
            "word": draw(len(vocabulary) + 1, WORD_SIZE, by=100),
            "char": draw(CHAR_CELLS, CHAR_SIZE, by=4),
            "A": draw(2 * STATE, ATTENTION),
            "v": draw(ATTENTION),
            "w": draw(2 * STATE),
            "b": np.zeros(1, F32),
        }
        for d in "fb":
            self.p |= {f"W{d}": draw(size, 3 * STATE), f"U{d}": draw(STATE, 3 * STATE), f"c{d}": np.zeros(3 * STATE, F32)}

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vocabulary=self.vocabulary, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Network:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as z:
            self.vocabulary, self.p = z["vocabulary"], {k: z[k] for k in z.files if k != "vocabulary"}
        return self

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in the vocabulary; the last row is for words that aren't in it."""
        n = len(self.vocabulary)
        if not n:
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), n - 1)
        return np.where(self.vocabulary[at] == hashes, at, n)

    def inputs(self, word: np.ndarray, cell: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words."""
        n = np.diff(np.append(first, len(cell))).astype(F32)[:, None]
        return np.concatenate([self.p["word"][word], _sums(self.p["char"][cell], first) / n], axis=1)

    def _read(self, x: np.ndarray, ids: np.ndarray, size: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States at all places of windows, longest first, read in direction ``d``; ``keep`` gets what gradients need."""
        n, window = ids.shape
        gates = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        u = self.p[f"U{d}"]
        out = np.zeros((window, n, STATE), F32)
        h = np.zeros((n, STATE), F32)
        rows = np.arange(n)
        for t in range(window):
            k = int(np.searchsorted(-size, -t, "left"))  # windows longer than t
            if not k:
                break
            place = np.full(k, t) if d == "f" else size[:k] - 1 - t
            g = gates[ids[rows[:k], place]]
            before = h[:k]
            inner = before @ u
            zr = _sigmoid(g[:, : 2 * STATE] + inner[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            new = np.tanh(g[:, 2 * STATE :] + r * inner[:, 2 * STATE :])
            after = new + z * (before - new)
            if keep is not None:
                keep.append((k, place, before.copy(), inner[:, 2 * STATE :], z, r, new))
            h[:k] = after
            out[place, rows[:k]] = after
        return out

    def score(self, x: np.ndarray, ids: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window (``ids``: rows of ``x``, one window in each row, longest first)."""
        window = ids.shape[1]
        steps = {d: [] if keep is not None else None for d in "fb"}
        h = np.concatenate([self._read(x, ids, size, d, steps[d]) for d in "fb"], axis=2)
        a = np.tanh(h @ self.p["A"])
        e = np.where(np.arange(window)[:, None] < size[None, :], a @ self.p["v"], F32(-1e9))
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", e, h)
        if keep is not None:
            keep |= {"steps": steps, "h": h, "a": a, "e": e, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"][0]

    def gradients(self, x: np.ndarray, ids: np.ndarray, size: np.ndarray, keep: dict, by: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of ``sum(by * logit)`` for the parameters above the inputs, and for the inputs."""
        g: dict[str, np.ndarray] = {}
        h, a, e, pooled = (keep[k] for k in ("h", "a", "e", "pooled"))
        g["w"], g["b"] = pooled.T @ by, by.sum(keepdims=True)
        dp = by[:, None] * self.p["w"]
        de = np.einsum("tnk,nk->tn", h, dp)
        de = e * (de - (e * de).sum(axis=0))
        da = (1 - a * a) * (de[:, :, None] * self.p["v"])
        g["v"] = np.einsum("tn,tnk->k", de, a)
        g["A"] = np.einsum("tni,tnj->ij", h, da)
        dh = e[:, :, None] * dp[None] + da @ self.p["A"].T
        dx = np.zeros_like(x)
        rows = np.arange(len(ids))
        for i, d in enumerate("fb"):
            w, u = self.p[f"W{d}"], self.p[f"U{d}"]
            into = np.zeros((len(x), 3 * STATE), F32)
            du = np.zeros_like(u)
            carry = np.zeros((len(ids), STATE), F32)
            for k, place, before, inner, z, r, new in reversed(keep["steps"][d]):
                s = carry[:k] + dh[place, rows[:k], i * STATE : (i + 1) * STATE]
                dn = s * (1 - z) * (1 - new * new)
                dz = s * (before - new) * z * (1 - z)
                dr = dn * inner * r * (1 - r)
                through = np.concatenate([dz, dr, dn * r], axis=1)
                du += before.T @ through
                carry[:k] = s * z + through @ u.T
                np.add.at(into, ids[rows[:k], place], np.concatenate([dz, dr, dn], axis=1))
            g |= {f"U{d}": du, f"W{d}": x.T @ into, f"c{d}": into.sum(axis=0)}
            dx += into @ w.T
        return g, dx


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, x in g.items():
            self.m[k] += F32(0.1) * (x - self.m[k])
            self.v[k] += F32(0.001) * (x * x - self.v[k])
            self.p[k] -= F32(rate) * self.m[k] / (np.sqrt(self.v[k]) + F32(1e-8))


def train(windows: list[list[str]], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Network of documents, given as the texts of some of their windows, with both labels among them."""
    text = pa.array([w for doc in windows for w in doc], pa.string())
    owner = np.repeat(np.arange(len(windows)), [len(doc) for doc in windows])
    words = words_of(*utf8(text), ALNUM)
    # One row for each distinct word; -1 are places behind a window's end.
    names, one, word = np.unique(words.hash, return_index=True, return_inverse=True)
    cell, first = char_cells(words, one)
    size = np.minimum(np.diff(words.first), WINDOW)
    at = np.minimum(words.first[:-1, None] + np.arange(WINDOW)[None, :], max(0, len(word) - 1))
    ids = word[at]
    used = size > 0
    ids, size, owner = ids[used], size[used], owner[used]
    # Words of enough documents.
    inside = np.arange(WINDOW)[None, :] < size[:, None]
    pairs = np.unique(ids[inside].astype(np.int64) * len(windows) + np.repeat(owner, size))
    net = Network(names[np.bincount(pairs // len(windows), minlength=len(names)) >= LEAST_DOCS], seed)
    own = net.word_ids(names)
    y = np.array(labels, F32)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(F32) * len(y)
    rng = np.random.default_rng(seed)
    adam = Adam(net.p, 0.01)
    bounds = np.searchsorted(owner, np.arange(len(windows) + 1))
    n_cells = np.diff(np.append(first, len(cell)))
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(windows)))
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - 0.8 * epoch / epochs)
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), BATCH):
            docs = order[lo : lo + BATCH]
            pick = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in docs])
            if not len(pick):
                continue
            pick = pick[np.argsort(-size[pick], kind="stable")]
            # The words of these windows only, some as if they were unknown, so that their parts are learnt too.
            near, inverse = np.unique(ids[pick], return_inverse=True)
            inverse = inverse.reshape(len(pick), -1)
            cells = np.concatenate([cell[first[i] : first[i] + n_cells[i]] for i in near])
            starts = np.cumsum(n_cells[near]) - n_cells[near]
            known = np.where(rng.random(len(near)) < 0.5, len(net.vocabulary), own[near])
            x = net.inputs(known, cells, starts)
            logit = net.score(x, inverse, size[pick])
            # A document is judged by its highest window; one of label 0 by its two highest.
            ranked = np.lexsort((-logit, owner[pick]))
            fresh = np.append(True, owner[pick][ranked][1:] != owner[pick][ranked][:-1])
            second = np.append(False, fresh[:-1]) & ~fresh
            judged = np.sort(ranked[fresh | (second & (y[owner[pick][ranked]] == 0))])
            keep: dict = {}
            logit = net.score(x, inverse[judged], size[pick][judged], keep)
            doc = owner[pick][judged]
            by = ((_sigmoid(logit) - y[doc]) * weight[doc] / len(docs)).astype(F32)
            g, dx = net.gradients(x, inverse[judged], size[pick][judged], keep, by)
            g["word"] = np.zeros_like(net.p["word"])
            np.add.at(g["word"], known, dx[:, :WORD_SIZE])
            g["char"] = np.zeros_like(net.p["char"])
            np.add.at(g["char"], cells, np.repeat(dx[:, WORD_SIZE:] / n_cells[near][:, None].astype(F32), n_cells[near], axis=0))
            adam.step(g)
    return net


def score_texts(net: Network, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the logit of its highest window (NaN without words), the first word of that window, and the number of windows."""
    words = words_of(*utf8(column), ALNUM)
    n_words = np.diff(words.first)
    best = np.full(len(n_words), np.nan)
    at = np.zeros(len(n_words), np.int64)
    doc, start, size = place_windows(n_words)
    count = np.bincount(doc, minlength=len(n_words))
    for lo in range(0, len(doc), 8192):  # of a long text, some windows at a time
        d, s, z = doc[lo : lo + 8192], start[lo : lo + 8192], size[lo : lo + 8192]
        order = np.argsort(-z, kind="stable")
        first = words.first[d] + s
        lowest, highest = int(first.min()), int((first + z).max())
        names, one, word = np.unique(words.hash[lowest:highest], return_index=True, return_inverse=True)
        x = net.inputs(net.word_ids(names), *char_cells(words, one + lowest))
        place = np.minimum(first[order, None] - lowest + np.arange(WINDOW)[None, :], len(word) - 1)
        logit = np.empty(len(d))
        logit[order] = net.score(x, word[place], z[order])
        # Of equally high windows the first; windows of a document stand together.
        rank = np.lexsort((s, -logit, d))
        top = rank[np.append(True, d[rank][1:] != d[rank][:-1])]
        better = ~(logit[top] <= best[d[top]])
        best[d[top[better]]], at[d[top[better]]] = logit[top[better]], s[top[better]]
    return best, at, count


def _training(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str, text_col: str, label_col: str, most: int) -> tuple[DataFrame, float]:
    """(part, id, label, windows) of the documents to train on, and the share of label 1 among all that could be."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.coalesce(may_learn, F.lit(False)))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label")).where("id is not null")
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("k")).first()
    sides = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(most) for k in (0, 1)]
    # 2 * ``most`` rows of two numbers.
    chosen = F.broadcast(sides[0].unionByName(sides[1]))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(chosen, "id")

    types = {"part": pa.int32(), "id": pa.int64(), "label": pa.int32(), "windows": pa.list_(pa.string())}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words = words_of(*utf8(b.column("text")), ALNUM)
            doc, start, size = place_windows(np.diff(words.first))
            bounds = np.searchsorted(doc, np.arange(b.num_rows + 1))
            out = []
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                some = np.unique(np.linspace(i, j - 1, min(j - i, TRAIN_WINDOWS)).astype(np.int64)) if j > i else np.zeros(0, np.int64)
                first = words.first[doc[some]] + start[some]
                out.append([words.text(a, z).decode() for a, z in zip(first.tolist(), (first + size[some]).tolist())])
            yield table({"part": [0] * len(out), "id": b.column("id"), "label": b.column("label"), "windows": out}, types)

    return rows.mapInArrow(cut, "part int, id long, label int, windows array<string>"), counts.k / max(1, counts.n)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most: int = TRAIN_DOCS,
) -> tuple[bytes | None, float]:
    """A trained network (None if a label has no document) and the share of label 1.

    ``may_learn``: an expression of the labels that says which may be learnt from.  ``most``: documents of each label.
    """
    rows, share = _training(docs, labels, may_learn, id_col, text_col, label_col, most)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, y, windows = (t.column(c).to_pylist() for c in ("id", "label", "windows"))
        kept = [i for i in range(len(ids)) if windows[i] and (i == 0 or ids[i] != ids[i - 1])]
        both = {y[i] for i in kept} == {0, 1}
        raw = train([windows[i] for i in kept], [y[i] for i in kept]).dump() if both else None
        give_back()
        return pa.table({"model": pa.array([raw], pa.binary())})

    # One group: the sample is bounded in documents and in windows of each.
    found = rows.groupBy("part").applyInArrow(run, "model binary").first()
    return (found.model if found else None), share


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most: int = TRAIN_DOCS,
) -> DataFrame:
    """(id, score, n_windows, window_word) per row; the last is where its highest window begins."""
    raw, share = fit(docs, labels, may_learn, id_col, text_col, label_col, most)
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    types = {"id": pa.int64(), "score": pa.float64(), "n_windows": pa.int64(), "window_word": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.load(shared.value) if shared.value is not None else None
        for b in slices(batches, "text", 1 << 20):
            n = b.num_rows
            if net is None:
                best, at, count = np.full(n, np.nan), np.zeros(n, np.int64), place_windows(np.diff(words_of(*utf8(b.column("text")), ALNUM).first))[0]
                count = np.bincount(count, minlength=n)
            else:
                best, at, count = score_texts(net, b.column("text"))
            wordless = np.isnan(best)
            score = np.where(wordless, share, 1 / (1 + np.exp(-np.clip(np.where(wordless, 0, best), -50, 50))))
            yield table({"id": b.column("id"), "score": score, "n_windows": count, "window_word": at}, types)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double, n_windows long, window_word long")
