import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import awkward, documents
from trackloom.llm import spelling
from trackloom.llm.spelling import Letters, count_words, near, one_edit, spelling_variants


def edits(w, alphabet):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[j:] for i in range(len(w) + 1) for c in alphabet for j in (i, i + 1) if j <= len(w)}
    return out - {w}


def expected(rows, min_chars=7, least=2, factor=10, one_in=31):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            k = crc32(f"{d}:{run}".encode()) if d is not None else 1
            if k % one_in == 0:
                run = run[: k % len(run)] + run[k % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_chars and k >= least}
    alphabet = {c for w in n for c in w}
    form, count = {}, {}
    for w in n:
        close = [x for x in edits(w, alphabet) if x in n]
        count[w] = len(close)
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], count[w], form[w], n.get(form[w]), root))
    return sorted(out)


def found(docs, **settings_):
    rows = spelling_variants(count_words(docs), **settings_).collect()
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in rows)


def corpus(seed, n_words, most):
    """Words at one or two edits of one another, some a thousand times as frequent as others."""
    rng = random.Random(seed)
    words = []
    while len(words) < n_words:
        w = rng.choice(words) if words and rng.random() < 0.8 else "".join(rng.choices("abcdeéñÿ", k=rng.randint(6, 12)))
        p = rng.randrange(len(w))
        words.append(w[:p] + rng.choice(["", "a", "é", "st"]) + w[p + rng.randint(0, 1) :])
    text = []
    for w in words:
        text += [w] * rng.choice([1, 2, 3, 25, 40, most])
    rng.shuffle(text)
    return [(k, " ".join(text[k::7]) + "!\nZusätzlich ZUSÄTZLICH") for k in range(7)]


def test_small_subtrees_and_blocks(spark):
    rows = awkward() + corpus(3, 250, 300)
    # Many words of one vector: they are dealt into blocks.
    rng = random.Random(1)
    rows += [(500 + k, " ".join("".join(rng.sample("abcdefgh", 8)) for _ in range(60))) for k in range(30)]
    rows += [(600, "x" * 5000 + " " + "x" * 5000 + "y " + "x" * 5000), (601, "x" * 5000 + "y")]
    docs = documents(spark, rows).selectExpr("*", "1 AS word", "2 AS n", "3 AS shard")
    want = expected(rows)
    assert len({w[5] for w in want}) < len(want) and max(w[2] for w in want) > 3
    for limit in (5, 40, 8192):
        assert found(docs, limit=limit) == want


def test_forms_of_forms(spark):
    rows = [(None, "aaaaaaaa " * 2 + "aaaaaaab " * 20 + "aaaaaabb " * 200 + "aaaaabbb " * 2000 + "aaaabbbb " * 20000)]
    got = {r[0]: (r[3], r[5]) for r in found(documents(spark, rows))}
    assert got["aaaaaaaa"] == ("aaaaaaab", "aaaabbbb") and got["aaaabbbb"] == (None, "aaaabbbb")


def test_empty(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "short words only"), (4, "longest once")])
    assert found(docs) == [] and found(docs.where("false")) == []


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=6), st.text("abé", max_size=6))
def test_one_edit(a, b):
    want = b in edits(a, "abé")
    assert one_edit(a, b) == want
    both = Letters([a, b])
    assert near(both, np.array([0]), both, np.array([1]))[0] == want


def test_wide_words():
    w = "ab" * 200
    words = [w, w + "a", w[:99] + "x" + w[100:], w[1:], w[::-1]]
    x = Letters(words)
    i, j = (k.ravel() for k in np.meshgrid(np.arange(5), np.arange(5)))
    assert near(x, i, x, j).tolist() == [one_edit(words[p], words[q]) for p, q in zip(i, j)]
    assert spelling._WIDE < len(w)
