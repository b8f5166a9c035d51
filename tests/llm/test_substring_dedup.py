from collections import Counter

import pytest

from tests.llm.cases import awkward, documents, prose
from trackloom.llm.substring_dedup import dedup_substrings


def expected(rows, n):
    least = {}
    for d, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - n + 1 if d is not None else 0):
            key = tuple(w[i : i + n])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, text in rows:
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - n + 1 if d is not None else 0):
            if least[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return Counter(out)


def cases():
    shared, loop = prose(70, 90), " ".join(["round and round"] * 40)
    return awkward() + [
        (40, prose(71, 60) + " " + shared + "\x0b" + prose(72, 60)),
        (41, shared.replace(" ", "  ")),
        (42, loop),
        (43, loop + " " + shared.upper()),
        (44, " ".join(shared.split()[:49])),
        (45, " ".join(shared.split()[:50])),
        (-3, "x " + " ".join(shared.split()[20:80]) + " y"),
        (46, shared),
        (46, shared + " but not the same row"),
    ]


@pytest.mark.parametrize(("n", "piece"), [(50, 1 << 20), (50, 100), (12, 300)])
def test_report(spark, n, piece):
    rows = cases()
    docs = documents(spark, rows).selectExpr("*", "1 AS rid", "2 AS places", "3 AS n_words").repartition(3)
    got = Counter(tuple(r) for r in dedup_substrings(docs, n, piece=piece).collect())
    assert got == expected(rows, n)


def test_one_passage_in_many_documents(spark):
    shared = prose(80, 70)
    rows = [(k, f"{prose(1000 + k, 20)} {shared} {prose(2000 + k, 20)}") for k in range(300)]
    got = Counter(tuple(r) for r in dedup_substrings(documents(spark, rows).repartition(6), piece=500).collect())
    assert got == expected(rows, 50) and sum(r[2] for r in got) >= 299 * 70


def test_empty_table(spark):
    assert dedup_substrings(documents(spark, cases()).limit(0)).count() == 0
