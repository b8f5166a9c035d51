from hashlib import sha256
from zlib import crc32

from pyspark.sql import functions as F

from tests.llm.cases import awkward, documents
from trackloom.llm.merkle import FIELDS, leaf_of, manifest, verified


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    out = ""
    for v in (row.doc_id, row.source, row.lang, row.n_chars, text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def walk(leaves, arity):
    """Root of a list of digests and, of each, the others beside its way: (those before, those behind) per level."""
    ways, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for k, i in enumerate(at):
            lo = i - i % arity
            ways[k].append((leaves[lo:i], leaves[i + 1 : lo + arity]))
            at[k] = i // arity
        leaves = [h(*leaves[i : i + arity]) for i in range(0, len(leaves), arity)]
    return leaves[0], ways


def expected(rows, arity, tampered):
    sources = sorted({r.source for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r) for r in rows if r.source == s), key=lambda x: x[:3]) for s in sources}
    low = {s: walk([x[2] for x in own[s]], arity) for s in sources}
    root, high = walk([low[s][0] for s in sources], arity)
    out = []
    for k, s in enumerate(sources):
        for (_, _, digest, r), way in zip(own[s], low[s][1]):
            path = way + high[k]
            now = leaf(r, r.text.replace("\n", "")) if tampered(r) and r.text is not None else digest
            for before, after in path:
                now = h(*before, now, *after)
            out.append((r.doc_id, digest, low[s][0], root, h(*[x for b, a in path for x in b + a]), now, now == root))
    return sorted(out, key=str)


def found(docs, arity):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    out = verified(manifest(docs, F.when(even, leaf_of(changed)), arity=arity))
    return sorted([tuple(r) for r in out.select("id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()], key=str)


def test_trees_of_many_sizes(spark):
    rows = awkward() + [(300 + k, f"line {k}\nend" if k % 3 else None) for k in range(45)]
    docs = documents(spark, rows).withColumn("source", F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("é" * 2), (F.col("doc_id") % 4 % 3).cast("string"))))
    docs = docs.unionByName(docs.where("doc_id = 301")).selectExpr("*", "1 AS tree", "2 AS number", "3 AS hash", "4 AS path")
    rows = docs.collect()
    tampered = lambda r: r.doc_id is not None and crc32(str(r.doc_id).encode()) % 2 == 0
    for arity in (2, 3):
        got = found(docs, arity)
        assert got == expected(rows, arity, tampered)
        assert not all(r[6] for r in got) and any(r[6] for r in got)


def test_one_row_and_empty(spark):
    one = documents(spark, [(7, "a")])
    (row,) = found(one, 3)
    assert row[1] == row[2] == row[3] and row[4] == h("")
    assert found(one.where("false"), 3) == []
