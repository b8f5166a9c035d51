import hashlib
import random
import re

from tests.llm.cases import awkward, documents, prose
from trackloom.llm.secret_filter import _KEY, FEATURES, assignment_labels, candidates, dictionary, scan_secrets


def findings(seed, n):
    rng, rows, truth = random.Random(seed), [], {}
    for k in range(n):
        kind, words = k % 3, prose(seed + k, 40).split()
        secret = hashlib.sha1(str(seed + k).encode()).hexdigest()
        long_word = "".join(rng.choices(["tion", "ung", "heit", "schaft", "able"], k=6))
        added = {0: ["token", "=", f'"{secret}"'], 1: [long_word], 2: [str(rng.randrange(10**15, 10**16))]}[kind]
        words[20:20] = added
        rows.append((5000 + k, " ".join(words)))
        truth[5000 + k, added[-1].strip('"')] = int(kind == 0)
    return rows, truth


def test_candidates_are_those_of_the_pattern(spark):
    rows = awkward() + findings(1, 30)[0] + [(900, 'a="' + "A1b2" * 5 + '","' + "C3d4" * 6 + '" ' + "x" * 5000)]
    got = sorted((r.doc_id, r.word, r.piece, r.candidate) for r in candidates(documents(spark, rows).selectExpr("*", "1 AS word", "2 AS c")).collect() if r.doc_id is not None)
    want = []
    for d, t in rows:
        if d is not None:
            for i, word in enumerate(re.split(r"[ \t\n\x0b\f\r]+", t or "")):
                want += [(d, i, n, x) for n, x in enumerate(re.findall(_KEY, word))]
    assert got == sorted(want)


def test_held_out_findings(spark):
    rows, truth = findings(2, 240)
    docs = documents(spark, rows)
    rows_labelled = [(r.doc_id, r.word, r.piece, truth.get((r.doc_id, r.candidate), 0)) for r in candidates(docs).collect() if r.doc_id % 2]
    labelled = spark.createDataFrame(rows_labelled, "doc_id long, word int, piece int, label int")
    got = scan_secrets(docs, labelled).collect()
    held = [r for r in got if r.doc_id % 2 == 0]
    right = [r.is_secret == bool(truth.get((r.doc_id, r.candidate), 0)) for r in held]
    assert len(held) >= 120 and sum(right) / len(right) >= 0.97
    assert all(0 <= r.score <= 1 and len(r.features) == len(FEATURES) and None not in r.features for r in got)


def test_labels_from_assignments_and_one_kind_only(spark):
    rows, truth = findings(3, 60)
    docs = documents(spark, rows)
    for r in assignment_labels(candidates(docs)).collect():
        assert r.label == truth.get((r.doc_id, r.candidate), 0)
    none = scan_secrets(docs.where("doc_id % 3 <> 2 AND doc_id < 0"))
    assert none.count() == 0
    only = scan_secrets(docs, assignment_labels(candidates(docs)).where("label = 0")).collect()
    assert only and all(r.score is None and r.is_secret for r in only)


def test_a_secret_is_found_where_nothing_assigns_it(spark):
    """Learnt from assigned ones; held out are secrets that stand bare between other words."""
    rows, truth = findings(5, 240)
    bare = [(9000 + d, t.replace('token = "', "then ").replace('"', "")) for d, t in rows if d % 2]
    docs = documents(spark, [r for r in rows if r[0] % 2 == 0] + bare)
    got = [r for r in scan_secrets(docs, assignment_labels(candidates(docs)).where("doc_id < 9000")).collect() if r.doc_id >= 9000]
    want = [truth.get((r.doc_id - 9000, r.candidate), 0) for r in got]
    hits = sum(w and r.is_secret for r, w in zip(got, want))
    assert sum(want) >= 30 and hits / sum(want) >= 0.95 and hits / sum(r.is_secret for r in got) >= 0.95


def test_dictionary_counts_documents(spark):
    docs = documents(spark, [(k, "Wort wort selten" if k == 0 else "Wort andere") for k in range(9)] + [(20, None), (21, "")])
    assert dictionary(docs, 2) == ["ande", "dere", "nder", "wort"]


def test_no_python_in_the_plan(spark):
    docs = documents(spark, findings(4, 30)[0])
    plan = scan_secrets(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    docs = documents(spark, awkward()).limit(0)
    assert scan_secrets(docs).count() == 0
