import random

import numpy as np
import pytest

from tests.llm.cases import alnum, awkward, documents, prose
from trackloom.llm import ngram_join
from trackloom.llm.groups import components, overlaps, roots
from trackloom.llm.ngram_join import keep_one, least_matches, similar_documents


def expected(rows, n=5, t=(4, 5)):
    sets = []
    for i, text in rows:
        w = alnum(text)
        size = min(n, len(w))
        sets.append((i, frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if w and i is not None else frozenset()))
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            met, union = len(sets[a][1] & sets[b][1]), len(sets[a][1] | sets[b][1])
            if met and t[1] * met >= t[0] * union:
                links[a].add(b)
                links[b].add(a)
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [sets[b][0] for b in seen]
        copies = [sets[b][0] for b in seen if sets[b][1] == sets[a][1]]
        out.append((sets[a][0], min(ids) if ids[0] is not None else None, min(copies) if ids[0] is not None else None, len(links[a])))
    return sorted(out, key=str)


def near_copies(seed, n, edits):
    rng, words = random.Random(seed), prose(seed, 150).split(" ")
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_links_and_classes(spark):
    rows = awkward() + [(100 + k, t) for k, t in enumerate(near_copies(7, 40, 6) + near_copies(8, 25, 9))]
    docs = documents(spark, rows).selectExpr("*", "1 AS key", "2 AS n_links", "3 AS class_id")
    got = similar_documents(docs).collect()
    assert sorted([tuple(r) for r in got], key=str) == expected(rows)


def test_blocks_do_not_change_links(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(near_copies(9, 60, 6))]
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    cells = ngram_join.cells
    monkeypatch.setattr(ngram_join, "cells", lambda packed: cells(packed, 7))
    assert sorted([tuple(r) for r in similar_documents(documents(spark, rows)).collect()], key=str) == expected(rows)


def test_one_document_of_each_group_stays(spark):
    rows = awkward()
    docs = documents(spark, rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = {d for d, c, _, _ in expected(rows) if d is not None and d == c}
    got = kept.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in got) == 1 and sum(r.doc_id == 12 for r in got) == 1


def test_empty_table(spark):
    docs = documents(spark, awkward()).limit(0)
    assert similar_documents(docs).count() == 0 and keep_one(docs).count() == 0


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_posterior_bound(threshold):
    """A pair at the threshold is dropped with about the tolerance's chance; an unlike one goes soon."""
    rng = np.random.default_rng(0)
    least = least_matches(threshold, 1e-6)
    for similarity, keep in ((threshold, True), (threshold / 4, False)):
        met = rng.random((2000, 128)) < similarity
        alive = np.ones(2000, bool)
        for n, m in least.items():
            alive &= met[:, :n].sum(axis=1) >= m
        assert alive.mean() > 0.999 if keep else alive.mean() < 0.001


def test_components(spark):
    rng = random.Random(3)
    names = [k.to_bytes(16, "big") for k in rng.sample(range(1, 10**6), 300)]
    edges = [(names[k], names[k + 1]) for k in range(100)] + [(names[150], names[k]) for k in range(151, 260)] + [(names[270], names[270])]
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a binary, b binary").repartition(5), "test-links").collect()
    got = {bytes(r.key): bytes(r.root) for r in got}
    for members in (names[:101], names[150:260]):
        assert {got[m] for m in members} == {min(members)}
    assert len(got) == 211


def test_overlaps_and_roots():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(9)]
    got = overlaps(sets)
    assert all(got[i, j] == (0 if i == j else len(set(sets[i].tolist()) & set(sets[j].tolist()))) for i in range(9) for j in range(9))
    linked = np.zeros((5, 5), bool)
    linked[3, 4] = linked[4, 3] = linked[1, 4] = linked[4, 1] = True
    assert roots(linked).tolist() == [0, 1, 2, 1, 1]
