import random

import numpy as np
import pytest

from tests.llm.cases import awkward, documents
from trackloom.llm.language import CELLS, fit, identify, keep_known, trigrams

PARTS = {"aa": ["ko", "ra", "mu", "ti", "se"], "bb": ["schr", "ung", "eit", "ßer"], "cc": ["éau", "oux", "ill", "ent"]}


def text(lang, seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 4))) for _ in range(n))


def labelled(spark, more=()):
    rows = [(k, text(lang, k, 60), lang, "s", 1) for k, lang in enumerate(list(PARTS) * 40)]
    return spark.createDataFrame([*rows, *more], "doc_id long, text string, lang string, source string, n_chars long")


def test_held_out_accuracy_and_mixtures(spark):
    mixed = text("aa", 901, 70) + " " + text("bb", 902, 30)
    docs = labelled(spark, [(900, mixed, None, None, None), (901, None, "aa", None, None), (902, "12 .. 34", "bb", None, None), (903, "", None, None, None)])
    got = {r.doc_id: r for r in identify(docs.selectExpr("*", "1 AS lang_pred", "2 AS score")).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 900]
    assert len(held) > 15 and all(r.lang_pred == list(PARTS)[r.doc_id % 3] and r.score > 0.9 for r in held)
    assert got[900].lang_pred == "aa" and got[900].languages == ["aa", "bb"] and 0.55 < got[900].score < 0.8
    assert [(got[k].lang_pred, got[k].score) for k in (901, 902, 903)] == [("und", 0.0)] * 3
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())


def test_awkward_rows(spark):
    docs = documents(spark, awkward()).unionByName(labelled(spark))
    got = identify(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert all((r.lang_pred == "und") == (r.score == 0) for r in got)
    kept = keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in got)
    assert keep_known(docs, ["bb"]).count() == sum(r.lang_pred == "bb" for r in got)


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = labelled(spark).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {r.lang_pred for r in identify(docs).collect()} == {"und"}
    assert identify(labelled(spark).limit(0)).count() == 0 and keep_known(labelled(spark).limit(0)).count() == 0


def test_pieces_of_a_long_text_count_like_the_whole(monkeypatch):
    long = "é, ".join(text("cc", k, 300) for k in range(4))
    h, n = trigrams(long)
    whole = np.bincount(h, weights=n, minlength=CELLS)
    monkeypatch.setattr("trackloom.llm.language._PIECE", 997)
    h, n = trigrams(long)
    assert np.abs(np.bincount(h, weights=n, minlength=CELLS) - whole).sum() <= 0.002 * whole.sum()


@pytest.mark.parametrize("share", [0.5, 0.8, 1.0])
def test_shares_are_the_maximum(share):
    """The fitted shares beat a fine grid of shares."""
    rng = np.random.default_rng(int(share * 10))
    p = rng.dirichlet(np.full(200, 0.3), size=2).T + 1e-9
    cells = np.concatenate([rng.choice(200, int(600 * share), p=p[:, 0] / p[:, 0].sum()), rng.choice(200, 600 - int(600 * share), p=p[:, 1] / p[:, 1].sum())])
    chosen, shares = fit(cells, np.ones(600), np.log(p).astype(np.float32))
    grid = max(np.log(p[cells] @ np.array([a, 1 - a])).sum() for a in np.linspace(0, 1, 501))
    full = np.zeros(2)
    full[chosen] = shares
    assert np.log(p[cells] @ full).sum() > grid - (0.05 if len(chosen) == 2 else 3 * np.log(601))
    assert (len(chosen) == 1) == (share == 1.0)
