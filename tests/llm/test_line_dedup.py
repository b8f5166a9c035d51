import random
from collections import Counter, defaultdict

import numpy as np

from tests.llm.cases import awkward, documents, prose
from trackloom.llm.groups import band_hashes, min_hashes
from trackloom.llm.line_dedup import BANDS, ROWS, dedup_lines, line_report
from trackloom.llm.queries import QUERIES
from trackloom.llm.words import mix


def expected(rows, min_chars=20, size=5):
    """Every pair of lines compared."""
    places = defaultdict(list)
    for d, text in rows:
        if d is not None and text is not None:
            for i, line in enumerate(text.split("\n")):
                if len(line) >= min_chars:
                    places[line].append((d, i))
    lines = list(places)
    sets = [frozenset(x[k : k + size] for k in range(len(x) - size + 1)) for x in lines]
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if sets[a] & sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [root[b] if r == root[a] else r for r in root]
    stays = {}
    for k, line in enumerate(lines):
        stays[root[k]] = min(stays.get(root[k], (10**18, 0)), min(places[line]))
    number = {line: k for k, line in enumerate(lines)}
    out = []
    for d, text in rows:
        if d is None or text is None:
            out.append((d, 0 if text is None else text.count("\n") + 1, 0, text))
            continue
        own = text.split("\n")
        kept = [x for i, x in enumerate(own) if x not in number or stays[root[number[x]]] == (d, i)]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return Counter(out)


def variants(seed):
    """Lines at many distances from one another."""
    rng, out = random.Random(seed), []
    for k in range(60):
        line = prose(seed + k % 12, 25).replace("\n", " ")
        for _ in range(rng.randint(0, 4)):
            p = rng.randrange(len(line))
            line = line[:p] + rng.choice("abcXYZé") + line[p + 1 :]
        out.append(line)
    return out


def test_report(spark):
    lines = variants(50)
    rows = awkward() + [(200 + k, "\n".join(["short", *lines[k::10], "", "tail"])) for k in range(10)]
    docs = documents(spark, rows).selectExpr("*", "1 AS line", "2 AS row", "3 AS n_removed")
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_report(docs).collect())
    # The line at the edge of the banding's recall is above the threshold by chance only.
    assert got == expected(rows)


def test_columns_stay(spark):
    rows = [*awkward(), (30, "A line that comes back, word for word."), (31, "A line that comes back, word for word.")]
    docs = documents(spark, rows).selectExpr("*", "doc_id AS lines", "text AS row")
    got = dedup_lines(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    left = {r[0] for r in expected(rows) if r[2] == 0 or r[3].strip()}
    assert {r.doc_id for r in dedup_lines(docs, drop_empty=True).collect()} == left and len(left) < len({r[0] for r in rows})


def test_empty_table(spark):
    docs = documents(spark, awkward()).limit(0)
    assert dedup_lines(docs).count() == 0 and line_report(docs).count() == 0


def test_pairs_at_the_threshold_meet():
    """Sets of 90 hashes that share 80 of 100: at the threshold, of 3,000 pairs none is missed."""
    assert (1 - 0.8**ROWS) ** BANDS < 2e-5
    n = 3000
    x = (mix(np.arange(n * 100, dtype=np.uint64), 5) >> np.uint64(32)).astype(np.uint32).reshape(n, 100)
    at = np.arange(n) * 90
    bands = [band_hashes(min_hashes(np.ascontiguousarray(s).ravel(), at, at + 90, BANDS * ROWS), BANDS, ROWS) for s in (x[:, :90], x[:, 10:])]
    met = (bands[0] == bands[1]).any(axis=1).sum()
    assert met == n


def test_registered_query_takes_short_lines(spark, tmp_path):
    rows = [(1, "short\n\nこの文は繰り返されます。\nab"), (2, "tail\nshort\nこの文は繰り返されます。\n\nab"), (3, "ba\nshort\n\n"), (4, None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_lines, r.n_removed) for r in QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {(1, 4, 0), (2, 5, 3), (3, 4, 1), (4, 0, 0)}


def test_short_lines_go_only_as_exact_copies(spark):
    rng = random.Random(5)
    rows = [(1, "pa\nAa"), (2, "Qb\nBB"), (3, "pa"), (4, "C#")]
    rows += [(10 + k, "\n".join("".join(rng.choices("abQpBC#", k=rng.randint(0, 6))) for _ in range(40))) for k in range(30)]
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_report(documents(spark, rows), min_chars=1).collect())
    assert got == expected(rows, 1)
    assert (2, 2, 0, "Qb\nBB") in got
