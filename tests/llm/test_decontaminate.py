import hashlib

import pytest

from tests.llm.cases import alnum, awkward, documents, prose
from trackloom.llm.decontaminate import contamination, decontaminate

ITEMS = [
    (1, " ".join(prose(999, 70).split()[5:30])),
    (2, "one"),
    (10, " ".join(prose(100, 120).split()[:14])),
    (3, " ".join(prose(100, 120).split()[:14])),
    (4, None),
    (None, prose(104, 120)),
    (5, ""),
    (6, " ".join(prose(5, 30_000).split()[29_000:29_020])),
    (6, " ".join(prose(5, 30_000).split()[100:120])),
]


def expected(rows, items, n=13):
    grams = {}
    for item, text in items:
        if item is None or text is None:
            continue
        w = alnum(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in rows:
        w, hit, met = alnum(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                found = grams.get(tuple(w[i : i + size]))
                if found:
                    hit.update(range(i, i + size))
                    met |= found
        out.append((doc, len(w), len(hit), sorted(met), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [200_000, 3])
def test_report(spark, most):
    rows = awkward()
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS doc_id")
    got = contamination(documents(spark, rows).selectExpr("*", "1 AS items", "2 AS n_hit"), bench, most=most).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got], key=str) == expected(rows, ITEMS)


def test_empty_tables(spark):
    docs, bench = documents(spark, awkward()), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(docs, bench.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
    assert contamination(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("most", [200_000, 10])
def test_documents_go_or_lose_their_spans(spark, most):
    rows = awkward()
    docs, bench = documents(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = [(d, t) for (d, t), e in zip(rows, [expected([r], ITEMS)[0] for r in rows]) if e[4]]
    kept = decontaminate(docs, bench, most=most)
    assert kept.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([r for r in rows if r not in bad], key=str)
    cut = {r.doc_id: r.text for r in decontaminate(docs, bench, remove="spans", most=most).collect()}
    assert cut[16] != prose(999, 70) and len(cut[16]) < len(prose(999, 70))
    assert cut[16] + "" == cut[16] and expected([(16, cut[16])], ITEMS)[0][2] == 0
    assert cut[5] == "" and cut[1] is None and cut[17] == dict(rows)[17]


def test_a_long_document_with_a_short_passage_is_clean(spark):
    rows = [(1, prose(1, 600) + " " + ITEMS[0][1])]
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    r = contamination(documents(spark, rows), bench).first()
    assert r.n_hit > 0 and not r.contaminated and hashlib.sha256(b"1").hexdigest()
