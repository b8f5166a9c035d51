import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import awkward, documents, prose
from trackloom.llm import toxicity as T
from trackloom.llm.queries import QUERIES
from trackloom.llm.words import ALNUM, utf8, words_of


def test_windows_cover_every_word():
    for n in [*range(0, 120), 500]:
        doc, start, size = T.place_windows(np.array([n, 0, n]), 48, 32)
        own = doc == 2
        seen = {k for a, z in zip(start[own], size[own]) for k in range(a, a + z)}
        assert seen == set(range(n)) and not (doc == 1).any()
        assert (np.diff(start[own]) == 32).all() and (size[own][:-1] == 48).all()


def small(seed=0, n_words=7):
    rng = np.random.default_rng(seed)
    net = T.Network(np.arange(1, 5, dtype=np.uint64), seed)
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64)
    x = rng.normal(size=(n_words, T.WORD_SIZE + T.CHAR_SIZE))
    size = np.array([6, 4, 4, 1])
    return net, x, rng.integers(0, n_words, (4, 6)), size


def plain_score(net, x, ids, size):
    """One window at a time, one word at a time."""
    p, s = net.p, T.STATE
    sig = lambda v: 1 / (1 + np.exp(-v))
    out = []
    for row, n in zip(ids, size):
        states = {}
        for d in "fb":
            h, states[d] = np.zeros(s), {}
            for t in range(n) if d == "f" else reversed(range(n)):
                g, u = x[row[t]] @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
                z, r = sig(g[:s] + u[:s]), sig(g[s : 2 * s] + u[s : 2 * s])
                h = (1 - z) * np.tanh(g[2 * s :] + r * u[2 * s :]) + z * h
                states[d][t] = h
        h = np.array([np.append(states["f"][t], states["b"][t]) for t in range(n)])
        e = np.exp(np.tanh(h @ p["A"]) @ p["v"])
        out.append((e / e.sum()) @ h @ p["w"] + p["b"][0])
    return np.array(out)


def test_scores_equal_the_plain_form():
    net, x, ids, size = small()
    assert np.allclose(net.score(x, ids, size), plain_score(net, x, ids, size), atol=1e-5)


def test_gradients_are_those_of_differences():
    net, x, ids, size = small(1)
    by = np.array([0.5, -1.0, 2.0, 1.5])
    keep = {}
    net.score(x, ids, size, keep)
    g, dx = net.gradients(x, ids, size, keep, by)
    rng = np.random.default_rng(2)
    places = [(net.p[k], g[k]) for k in ("A", "v", "w", "b", "Wf", "Wb", "Uf", "Ub", "cf", "cb")] + [(x, dx)]
    for values, grad in places:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in values.shape)
            old, f = values[at], []
            for step in (1e-4, -1e-4):
                values[at] = old + step
                f.append(float((by * plain_score(net, x, ids, size)).sum()))
            values[at] = old
            assert grad[at] == pytest.approx((f[0] - f[1]) / 2e-4, rel=2e-2, abs=2e-4)


def test_windows_of_a_text_are_all_scored():
    net = T.Network(np.zeros(0, np.uint64), 3)
    texts = [prose(1, 130), "", "one", prose(2, 700), None, "..."]
    best, at, count = T.score_texts(net, pa.array(texts))
    for k, text in enumerate(texts):
        words = words_of(*utf8(pa.array([text])), ALNUM)
        doc, start, size = T.place_windows(np.diff(words.first))
        assert count[k] == len(doc)
        if not len(doc):
            assert np.isnan(best[k])
            continue
        each = [T.score_texts(net, pa.array([words.text(a, a + z).decode()]))[0][0] for a, z in zip(start.tolist(), size.tolist())]
        assert best[k] == pytest.approx(max(each), abs=1e-4)
        assert each[start.tolist().index(at[k])] == pytest.approx(max(each), abs=1e-4)


def labelled(spark, n=240):
    """Texts with a bad word, its spellings differing, and texts without."""
    rng, rows, y = random.Random(4), [], []
    for k in range(n):
        words = prose(900 + k, rng.choice([5, 30, 60, 200])).split(" ")
        if k % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "Blockheads", "blockheaded", "BLOCKHEAD!"]))
        rows.append((k, " ".join(words)))
        y.append((k, int(k % 3 == 0), 1))
    return rows, spark.createDataFrame(y, "doc_id long, toxic int, quality int")


def test_learns_and_keeps_held_out_labels_out(spark):
    rows, labels = labelled(spark)
    extra = awkward()
    docs = documents(spark, rows + [(None if d is None else d + 1000, t) for d, t in extra])
    docs = docs.unionByName(docs.where("doc_id = 0")).selectExpr("*", "1 AS score", "2 AS part", "3 AS label", "4 AS id")
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, 1), (99999, 1, 0), (3, 0, 0)], labels.schema))
    may = F.col("doc_id") % 4 != 1
    got = T.score_toxicity(docs, labels, may).collect()
    assert len(got) == len(rows) + len(extra) + 1
    score = {r.id: r.score for r in got if r.id is not None}
    held = [k for k in range(len(rows)) if k % 4 == 1]
    assert np.mean([(score[k] >= T.THRESHOLD) == (k % 3 == 0) for k in held]) >= 0.95
    wordless = [r for r in got if r.n_windows == 0]
    assert len(wordless) >= 2 and len({r.score for r in wordless}) == 1 and 0.2 < wordless[0].score < 0.5
    # Other labels of rows that may not be learnt from change nothing.
    turned = labels.withColumn("toxic", F.when(~may, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.id: r.score for r in T.score_toxicity(docs, turned, may).collect() if r.id is not None}
    assert again == score


def test_without_labels_and_empty(spark):
    rows, labels = labelled(spark, 6)
    docs = documents(spark, rows)
    assert {r.score for r in T.score_toxicity(docs, labels.where("false"), F.lit(True)).collect()} == {0.0}
    assert {r.score for r in T.score_toxicity(docs, labels.where("toxic = 1"), F.lit(True)).collect()} == {1.0}
    assert T.score_toxicity(docs.where("false"), labels, F.lit(True)).count() == 0


def test_registered_query_on_held_out_rows(spark):
    got = QUERIES["op13_toxicity"](spark, "/root/testdata/sf0.01")
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    bad, good = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    better = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    # A few dozen documents of label 1 are learnt from here.
    assert better > 0.55 and np.mean(np.array(good) >= T.THRESHOLD) < 0.1
