"""The registered queries of the text operators and their SQL texts."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.decontaminate import contamination
from trackloom.llm.language import identify
from trackloom.llm.line_dedup import line_report
from trackloom.llm.merkle import FIELDS, leaf_of, manifest, verified
from trackloom.llm.ngram_join import similar_documents
from trackloom.llm.packing import pack
from trackloom.llm.pseudo_likelihood import score_documents
from trackloom.llm.secret_filter import scan_secrets
from trackloom.llm.spelling import count_words, spelling_variants
from trackloom.llm.substring_dedup import dedup_substrings
from trackloom.llm.topk import exact_top_k
from trackloom.llm.toxicity import THRESHOLD, score_toxicity
from trackloom.llm.warc import read_archives, write_archives
from trackloom.plans.stages import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def wide_rows(spark: SparkSession, most: int = 1_000) -> None:
    """For jobs over texts: batches for Python of at most ``most`` rows, as a row may hold some kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wide_rows(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies; it must lie there on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_read(spark, sf_dir, "documents"))


@_query
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


ORACLES["op2_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


@_query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_report(_read(spark, sf_dir, "documents"), min_chars=1)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@_query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_read(spark, sf_dir, "documents"))


@_query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), tokenizer_path())


@_query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated"
    )


ORACLES["op6_decontaminate"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 13) AS n FROM items WHERE len(w) > 0) x) y),
spans AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM words, (SELECT DISTINCT n FROM grams) k WHERE len(w) >= n) x),
met AS (SELECT doc_id, i, s.n, item_id FROM spans s JOIN grams g ON s.n = g.n AND s.gram = g.gram),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) x GROUP BY 1),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) x GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM words d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@_query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op7_substring_dedup"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spans AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS content
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50) x),
least_doc AS (SELECT content, min(doc_id) AS lo FROM spans GROUP BY 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM (SELECT s.doc_id, s.i FROM spans s JOIN least_doc l USING (content) WHERE s.doc_id > l.lo) x),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


@_query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "word", "piece", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "is_secret")


@_query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_read(spark, sf_dir, "documents"))


ORACLES["op9_ngram_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 5) AS n FROM words WHERE len(w) > 0) x) y),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS content FROM grams GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 9 * met.n >= 4 * (x.n + y.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1),
copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY content) AS copy_id FROM sizes),
counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT doc_id, class_id, coalesce(copy_id, doc_id) AS copy_id, coalesce(n_links, 0) AS n_links
FROM class LEFT JOIN copies USING (doc_id) LEFT JOIN counts USING (doc_id)
"""


@_query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/trackloom/warc-{uuid.uuid4().hex}"
    write_archives(_read(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path, with_payload=False).where("gap_reason IS NULL")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, html, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS kept FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(1, 41),
    lambda i: lpad(bin(position(sha[i] IN '0123456789abcdef') - 1), 4, '0')), '') AS bits FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT)
    + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT)]), '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM b
"""


@_query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    changed = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, leaf_of(changed))
    found = verified(manifest(docs, tampered))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified"
    )


#: Unsigned crc32 of a text, for SQL texts; needs ``crc_table`` beside it.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(range(0, 9), lambda c, x: CASE WHEN x = 0 THEN c WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256)) AS i) x)"""


def _crc32(text: str) -> str:
    digit = "position(substr(hex({0}), {1}, 1) IN '123456789ABCDEF')"
    byte = f"16 * {digit.format(text, '2 * i - 1')} + {digit.format(text, '2 * i')}"
    return (
        f"xor(4294967295, list_reduce(list_transform(range(1, strlen({text}) + 1), lambda i: CAST({byte} AS BIGINT)),"
        " lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), CAST(4294967295 AS BIGINT)))"
    )


_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in FIELDS)

ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE {_CRC_TABLE},
docs AS (
  SELECT doc_id, source, sha256({_LEAF}) AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN sha256({_LEAF.replace(_FIELD.format("text"), _FIELD.format("replace(text, chr(10), '')"))})
    END AS changed
  FROM documents, crc_table),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS number FROM docs),
low AS (
  SELECT tree, CAST(0 AS BIGINT) AS level, number, count(*) OVER (PARTITION BY tree) AS n, leaf AS hash FROM placed
  UNION ALL
  SELECT tree, level + 1, number // 3, (max(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY number)) FROM low WHERE n > 1 GROUP BY tree, level, number // 3),
subroots AS (SELECT tree, hash FROM low WHERE n = 1),
high AS (
  SELECT CAST(-1 AS BIGINT) AS tree, CAST(0 AS BIGINT) AS level, tree AS number, count(*) OVER () AS n, hash FROM subroots
  UNION ALL
  SELECT tree, level + 1, number // 3, (max(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY number)) FROM high WHERE n > 1 GROUP BY tree, level, number // 3),
nodes AS (SELECT * FROM low UNION ALL SELECT * FROM high),
sides AS (
  SELECT tree, level, number, n, coalesce(lag(hash, 2) OVER w, '') || coalesce(lag(hash, 1) OVER w, '') AS l,
    coalesce(lead(hash, 1) OVER w, '') || coalesce(lead(hash, 2) OVER w, '') AS r
  FROM nodes WINDOW w AS (PARTITION BY tree, level, number // 3 ORDER BY number)),
way AS (
  SELECT doc_id, leaf, tree AS own, tree, CAST(0 AS BIGINT) AS level, number, coalesce(changed, leaf) AS now, '' AS proof, (SELECT max(n) FROM sides s WHERE s.tree = p.tree AND s.level = 0) AS n
  FROM placed p
  UNION ALL
  SELECT doc_id, leaf, own, CASE WHEN y.n > 1 THEN y.tree ELSE -1 END, CASE WHEN y.n > 1 THEN y.level + 1 ELSE 0 END, CASE WHEN y.n > 1 THEN y.number // 3 ELSE y.tree END,
    CASE WHEN y.n > 1 THEN sha256(s.l || now || s.r) ELSE now END, CASE WHEN y.n > 1 THEN proof || s.l || s.r ELSE proof END,
    CASE WHEN y.n > 1 THEN (y.n + 2) // 3 ELSE (SELECT count(*) FROM subroots) END
  FROM way y JOIN sides s ON s.tree = y.tree AND s.level = y.level AND s.number = y.number
  WHERE y.n > 1 OR y.tree >= 0)
SELECT doc_id, leaf, (SELECT hash FROM subroots u WHERE u.tree = own) AS subroot, (SELECT hash FROM high WHERE n = 1) AS root,
  sha256(proof) AS proof_sha256, now AS folded_root, now = (SELECT hash FROM high WHERE n = 1) AS verified
FROM way WHERE tree = -1 AND n = 1
"""


@_query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(count_words(_read(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


ORACLES["op12_spelling_variants"] = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
each AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
hashed AS (SELECT run, k, CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc32("(doc_id || ':' || run)")} END AS h FROM each, crc_table),
worn AS (
  SELECT k, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM worn WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, left(word, CAST(i AS INT) - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) x),
met AS (
  SELECT DISTINCT c.word AS a, w.word AS b, c.n AS a_n, w.n AS b_n FROM cut c JOIN words w ON c.rest = w.word
  UNION ALL
  SELECT x.word, y.word, x.n, y.n FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word < y.word),
pairs AS (SELECT a AS word, a_n AS n, b AS other, b_n AS other_n FROM met UNION ALL SELECT b, b_n, a, a_n FROM met),
best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, max(other_n) AS best_n, arg_min(other, (-other_n, encode(other))) AS best FROM pairs GROUP BY 1),
forms AS (SELECT word, best AS form, best_n FROM best WHERE best_n >= 10 * n),
way AS (
  SELECT word, word AS last, 0 AS step FROM words
  UNION ALL
  SELECT y.word, f.form, step + 1 FROM way y JOIN forms f ON f.word = y.last),
ends AS (SELECT word, arg_max(last, step) AS root FROM way GROUP BY 1)
SELECT word, form, root, w.n, coalesce(n_near, 0) AS n_near, f.best_n AS form_n
FROM words w JOIN ends USING (word) LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word)
"""


@_query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), ~part("doc_id"))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return found.select(F.col("id").alias("doc_id"), part("id").alias("held_out"), "score", predicted.alias("predicted"), "n_windows", "window_word")
