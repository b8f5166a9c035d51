"""A task of the pipeline runs one Python step, as the workers of a second one stay on the executor."""

import re

import pytest

from tests.llm.cases import documents, prose
from trackloom.llm import groups
from trackloom.llm.line_dedup import dedup_lines
from trackloom.llm.ngram_join import keep_one, similar_documents

PYTHON = re.compile(r"(\*\(\d+\) )?(MapInArrow|FlatMapGroupsInArrow)")


def chained(df):
    """Python steps of the physical plan that feed another one without an exchange."""
    found, above = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        start = re.search(r"[A-Za-z*]", line)
        if not start:
            continue
        name = line[start.start() :]
        while above and above[-1][0] >= start.start():
            above.pop()
        if PYTHON.match(name):
            nearest = next((n for _, n in reversed(above) if PYTHON.match(n) or "Exchange" in n), "")
            found += [name] if PYTHON.match(nearest) else []
        above.append((start.start(), name))
    return found


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"{prose(k % 20, 40)}\n{prose(900 + k, 30)}") for k in range(60)]
    return documents(spark, [*rows, (None, prose(1, 40)), (3, rows[3][1]), (99, None), (98, "")])


def test_removed_lines_meet_their_documents_after_a_shuffle(docs):
    out = dedup_lines(docs)
    assert not chained(out)
    assert out.count() == docs.count() and out.where("text IS NULL").count() == 1


def test_kept_documents_are_keyed_where_they_are_read(docs):
    out = keep_one(docs)
    assert not chained(out)
    assert {98, 99, None} <= {r.doc_id for r in out.collect()}


def test_candidates_are_united_after_a_shuffle(docs, monkeypatch):
    seen = {}
    plain = groups.stage
    monkeypatch.setattr(groups, "stage", lambda df, name, *rest: (seen.setdefault(name, chained(df)), plain(df, name, *rest))[1])
    similar_documents(docs)
    assert "ngram-candidates" in seen and not any(seen.values())
