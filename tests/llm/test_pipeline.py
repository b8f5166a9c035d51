"""The whole pipeline against plain Python, stage by stage, on a small table."""

from zlib import crc32

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.cases import awkward, documents, prose
from tests.llm.test_decontaminate import expected as hits
from tests.llm.test_line_dedup import expected as lines
from tests.llm.test_ngram_join import expected as classes
from trackloom.llm.queries import tokenizer_path


def test_stages(spark, tmp_path):
    base = prose(300, 200).replace("\n", " ")
    item = " ".join(prose(301, 40).split())
    rows = awkward() + [
        (50, base),
        (51, base.replace(" ", "  ", 3) + " and one more word"),
        (52, item),
        (53, prose(302, 900) + " " + item),
        (54, "12345 67890 !!"),
        (55, prose(303, 30) + "\n" + "A footer line that comes back in many documents."),
        (56, prose(304, 30) + "\n" + "A footer line that comes back in many documents!"),
    ]
    sf = f"file://{tmp_path}"
    documents(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    kept = [(d, t) for d, t in rows if t is not None and any(c.isalpha() for c in t)]
    kept = [(d, t) for d, _, gone, t in lines(kept).elements() if not gone or t.strip()]
    seen, single = set(), []
    answers = {}
    for d, c, _, _ in classes(kept):
        answers.setdefault(d, c)
    for d, t in kept:
        if d is None or (answers[d] == d and (d, t) not in seen):
            single.append((d, t))
            seen.add((d, t))
    clean = [r for r in single if not hits([r], [(1, item)])[0][4]]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    want = sorted((str(d), len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for d, t in clean)

    got = corpus_pipeline.run(spark, sf).collect()
    total = {}
    for r in got:
        total.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, r.length))
    assert sorted(total) == sorted(set(want))
    assert sum(r.length for r in got) == sum(n for _, n in want)
    one = next(r for r in got if r.doc_id == 53 and r.start == 0)
    ids = np.array(tokenizer.encode(dict(clean)[53], add_special_tokens=False).ids + [1], "<u4")
    assert one.ids_crc32 == crc32(ids[: one.length].tobytes())
    assert {53, 55, 56, 50} <= {r.doc_id for r in got} and not {51, 52, 54} & {r.doc_id for r in got}


def test_all_but_the_last_stage_keep_the_columns(spark, tmp_path):
    docs = documents(spark, awkward())
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns and out.schema == docs.schema
        assert stage(spark, docs.limit(0), f"file://{tmp_path}").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "ngram_join", "decontaminate", "packing"]
