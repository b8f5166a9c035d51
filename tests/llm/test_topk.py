import math
import random

import numpy as np
import pytest

from trackloom.llm import topk
from trackloom.llm.topk import Tree, exact_top_k, search

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, step, k):
    points = {}
    for i, v, _ in rows:
        if i is None or not v or any(x is None or not math.isfinite(np.float32(x)) for x in v):
            continue
        e = [math.floor(256 * float(np.float32(x))) for x in v]
        points[i] = min(points.get(i, e), e)
    out = []
    for q, e in points.items():
        if q % step == 0:
            best = sorted((-sum(a * b for a, b in zip(e, c)), i) for i, c in points.items() if i != q and len(c) == len(e))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def vectors(n, d, seed=1, levels=None):
    rng = random.Random(seed)
    pick = (lambda: rng.choice(levels)) if levels else (lambda: rng.gauss(0, 0.3))
    return [(i, [pick() for _ in range(d)], 0) for i in range(n)]


AWKWARD = [
    (1000, None, 1),
    (1001, [], 1),
    (1002, [0.1, None, 0.2, 0.3], 1),
    (1050, [float("nan")] * 4, 1),
    (1100, [float("inf"), 0.0, 0.0, 0.0], 1),
    (None, [0.1, 0.2, 0.3, 0.4], 1),
    (1150, [0.5, -0.5], 1),
    (1151, [0.5, -0.25], 1),
    (0, [0.0, 0.0, 0.0, 0.0], 1),
    (-50, [1.0, 0.5, -1.0, 0.25], 1),
    (-50, [1.0, 0.5, -1.0, 0.25], 1),
]


@pytest.mark.parametrize(("rows", "step", "k"), [(vectors(700, 4) + AWKWARD, 50, 5), (vectors(300, 3, levels=[-1.0, 0.0, 0.5]), 20, 7), (vectors(4, 5), 1, 5)])
def test_result(spark, monkeypatch, rows, step, k):
    monkeypatch.setattr(topk, "SHARD", 150)
    monkeypatch.setattr(topk, "GROUP", 6)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "2 AS shard", "3 AS v")
    got = exact_top_k(df, lambda i: i % step == 0, k).collect()
    assert sorted(tuple(r) for r in got) == expected(rows, step, k)


def test_large_components_do_not_round(spark):
    rows = [(i, [1.0e6 + i, -2.0e5 * i, 1.0], 0) for i in range(12)]
    got = exact_top_k(spark.createDataFrame(rows, SCHEMA), lambda i: i % 3 == 0, 4).collect()
    assert sorted(tuple(r) for r in got) == expected(rows, 3, 4)


def test_empty_table(spark):
    assert exact_top_k(spark.createDataFrame([], SCHEMA), lambda i: i % 50 == 0).count() == 0


def test_boxes_bound_scores_and_prune():
    rng = np.random.default_rng(2)
    points = np.floor(rng.normal(0, 60, (3000, 3)) + 300 * rng.integers(0, 4, (3000, 1)))
    tree = Tree(points, 32)
    for node, (lo, hi) in enumerate(tree.range):
        own = tree.points[lo:hi]
        q = rng.integers(-99, 99, 3).astype(float)
        assert (own >= tree.low_[node]).all() and (own <= tree.high_[node]).all()
        assert tree.bounds([node], q)[0] >= (own @ q).max()
    leaves = sum(c is None for c in tree.child)
    opened = []
    whole = tree.points

    class Seen:
        def __getitem__(self, at):
            opened.append(at)
            return whole[at]

    tree.points = Seen()
    ids, q = np.arange(3000), np.array([5.0, 1.0, 2.0])
    best = search(tree, ids, q, -1, 5, None)
    assert [s for s, _ in best] == sorted((points @ q).astype(int).tolist(), reverse=True)[:5]
    assert len(opened) < leaves / 4
    opened.clear()
    assert search(tree, ids, q, -1, 5, best[-1][0]) == best and search(tree, ids, q, -1, 5, best[0][0] + 1) == [] and len(opened) < leaves / 4
