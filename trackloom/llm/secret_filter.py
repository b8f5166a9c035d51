"""Candidate secrets in texts and a random forest that removes false positives.

Only DataFrame functions and Spark's own forest are used.  A candidate is a run of at least ``MIN_LENGTH``
key characters.  Its features: length, how often the kind of character changes, shares of kinds, coverage by
the dictionary, the form of the path it was found under, and how much of the words around it the dictionary
covers.  None of them reads what ``assignment_labels`` decides by (key words, signs of assignment, quotes), so
a secret is found by its own form also where it isn't assigned to anything.  The dictionary are the
four-letter pieces of the ``DICTIONARY`` words that most documents of the whole input hold.

The forest learns from labelled findings: (features, label) rows, of which it takes the ``MOST_TRAINING``
of each label with the smallest hash, a bound that is a parameter.  ``assignment_labels`` labels findings by
the syntax around them (the quoted value of an assignment to a key word), for inputs without labels of
their own.  Every candidate is then scored.

Defined results: null texts have no candidates; null ids and paths are allowed; rows that repeat give their
candidates again; with labels of one kind only (or none) nothing is learnt, scores are null and all
candidates stay.  Only id, text and path of the input are used, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.plans.stages import stage

MIN_LENGTH, DICTIONARY, MOST_TRAINING = 16, 2_000, 10_000
TREES, DEPTH, SEED = 20, 6, 7
_KEY = f"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}"
_KEY_WORDS = "(?i)(token|secret|passw|credential|api.?key|access.?key|private.?key|auth|bearer)"
_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"

FEATURES = [
    "length",
    "kind_changes",
    "vowel_changes",
    "digits",
    "uppers",
    "hex",
    "distinct",
    "dictionary",
    "slashes",
    "word_before",
    "word_after",
    "path_depth",
    "path_of_examples",
]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(doc_id, path, word, piece, candidate, token, before2, before1, after): word counts from 0, a word may
    hold several pieces."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("text").rlike(_KEY)).withColumn("words", F.split("text", r"\s+"))

    def at(i: Column, by: int) -> Column:
        return F.get("words", i + by)

    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (F.length(at(i, 0)) >= MIN_LENGTH) & at(i, 0).rlike(_KEY))
    around = F.transform(
        places, lambda i: F.struct(i.alias("word"), at(i, 0).alias("token"), at(i, -2).alias("before2"), at(i, -1).alias("before1"), at(i, 1).alias("after"))
    )
    found = rows.select("doc_id", "path", F.explode(around).alias("c")).select("doc_id", "path", "c.*")
    return found.select("*", F.posexplode(F.regexp_extract_all("token", F.lit(_KEY), F.lit(0))).alias("piece", "candidate"))


def dictionary(docs: DataFrame, words: int = DICTIONARY, text_col: str = "text") -> list[str]:
    """Four-letter pieces of the words of 4 to 10 letters that most documents hold, counted over all of them."""
    of_text = F.array_distinct(F.filter(F.split(F.lower(text_col), r"[^\p{L}]+"), lambda w: F.length(w).between(4, 10)))
    counted = docs.select(F.explode(of_text).alias("w")).groupBy("w").count()
    top = counted.orderBy(F.desc("count"), "w").limit(words).collect()  # at most ``words`` rows
    return sorted({r.w[i : i + 4] for r in top for i in range(len(r.w) - 3)})


def _pieces(text: Column) -> Column:
    n = F.length(text) - 3
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(4))))).otherwise(
        F.array().cast("array<string>")
    )


def _coverage(text: Column, known: list[str]) -> Column:
    pieces = _pieces(F.lower(F.coalesce(text, F.lit(""))))
    words = F.array(*[F.lit(w) for w in known]) if known else F.array().cast("array<string>")
    return F.when(F.size(pieces) > 0, F.size(F.array_intersect(pieces, words)) / F.size(pieces)).otherwise(0.0)


def _share(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")) / F.length(text)


def _changes(kinds: Column) -> Column:
    """Places where a character's kind differs from the one before, per place."""
    return (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / (F.length(kinds) - 1)


def with_features(found: DataFrame, known: list[str]) -> DataFrame:
    c = F.col("candidate")
    kinds = F.translate(c, _UPPER + _LOWER + _DIGIT + "+/_=-", "U" * 26 + "l" * 26 + "d" * 10 + "ooooo")
    sounds = F.translate(F.lower(c), _LOWER, "".join("v" if x in "aeiouy" else "c" for x in _LOWER))
    path = F.coalesce("path", F.lit(""))
    features = {
        "length": F.length(c),
        "kind_changes": _changes(kinds),
        "vowel_changes": _changes(sounds),
        "digits": _share(c, "[^0-9]"),
        "uppers": _share(c, "[^A-Z]"),
        "hex": _share(c, "[^0-9a-fA-F]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(F.length(c), F.lit(64)),
        "dictionary": _coverage(c, known),
        "slashes": F.length(c) - F.length(F.replace(c, F.lit("/"))),
        "word_before": _coverage(F.col("before2"), known),
        "word_after": _coverage(F.col("after"), known),
        "path_depth": F.length(path) - F.length(F.replace(path, F.lit("/"))),
        "path_of_examples": path.rlike("(?i)test|example|sample|mock|fixture|doc").cast("int"),
    }
    return found.select("*", F.struct(*[features[k].cast("double").alias(k) for k in FEATURES]).alias("features"))


def assignment_labels(found: DataFrame) -> DataFrame:
    """``label`` 1 for the quoted value of an assignment to a key word, 0 for others."""
    text = F.concat_ws(" ", "before2", "before1", "token")
    return found.withColumn("label", text.rlike(_KEY_WORDS + r"\w*\s*[=:]\s*[\"'`][^\s]*$").cast("int"))


def learn(findings: DataFrame, most: int = MOST_TRAINING) -> PipelineModel | None:
    """Forest from (features, label) rows; None if there is only one label."""
    order = F.xxhash64("features")
    rows = [findings.where(F.col("label") == k).orderBy(order).limit(most).select("features.*", "label") for k in (0, 1)]
    sample = stage(rows[0].unionByName(rows[1]), "findings-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    vector = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    forest = RandomForestClassifier(featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[vector, forest]).fit(sample)


def judge(found: DataFrame, model: PipelineModel | None, threshold: float = 0.5) -> DataFrame:
    """Adds ``score``, the forest's probability of a secret, and ``is_secret``."""
    if model is None:
        return found.withColumn("score", F.lit(None).cast("double")).withColumn("is_secret", F.lit(True))
    names = found.columns
    row = found.select(F.struct(*names).alias("row"), "features.*")
    scored = model.transform(row).select("row.*", vector_to_array("probability")[1].alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= threshold)


def scan_secrets(
    docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source"
) -> DataFrame:
    """Every candidate with its features, score and verdict.

    ``labelled``: (doc_id, word, piece, label) of findings in ``docs``; without it ``assignment_labels`` rules.
    """
    known = dictionary(docs, text_col=text_col)
    found = stage(with_features(candidates(docs, id_col, text_col, path_col), known), "findings")
    if labelled is None:
        findings = assignment_labels(found)
    else:
        findings = found.join(labelled.select("doc_id", "word", "piece", "label"), ["doc_id", "word", "piece"])
    return judge(found, learn(findings), threshold)
