"""Language of documents as a mixture: shares of the known languages in each text.

A text is lower-cased, runs of anything but letters become one blank, and its character trigrams are
hashed to ``CELLS`` cells.  Training counts the cells of all labelled training texts, language by language,
in the tasks; the counts, merged slice by slice in two steps (languages x CELLS numbers, whatever the input) give smoothed
probabilities that are broadcast.  For a document, expectation-maximisation fits the shares of a set of
languages.  The set grows from the best single language: the language with the steepest gain is tried, and
kept only if the log-likelihood gains more than the penalty of one more language.  As the log-likelihood is
concave, ``n log(gradient)`` bounds the gain, which ends most documents without a fit.

Defined results: null text or text without a letter is ``und`` with score 0, as is every document when there
is nothing to learn from; ties go to the language first in the alphabet; a null id is not held out and not
trained on; training leaves out null languages.  ``identify`` takes id, text and language only, so other
columns can't clash; ``keep_known`` returns the input's rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm import bloom
from trackloom.llm.words import slices, table

CELLS = 1 << 16
#: Cells of one slice of a task's counts: 64 KB.
_SLICE = 1 << 13
UNKNOWN = "und"
#: Log-likelihood that one more language must gain: this many times the logarithm of the number of trigrams.
PENALTY = 3.0
ROUNDS = 30
#: Trigrams are gathered in pieces of this many characters.
_PIECE = 1 << 18


@dataclass
class Model:
    names: list[str]
    log_p: np.ndarray  # (CELLS, languages)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = True
    return out


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a text's trigrams and how often each occurs."""
    text = text.lower()
    if len(text) <= _PIECE:
        h = _cells(text, " ", " ")
        return h, np.ones(len(h))
    counts = np.zeros(CELLS, np.int64)
    for i in range(0, len(text), _PIECE):
        before = text[max(0, i - 2) : i] or " "
        counts += np.bincount(_cells(text[i : i + _PIECE], before, " " if i + _PIECE >= len(text) else ""), minlength=CELLS)
    h = np.flatnonzero(counts)
    return h, counts[h].astype(np.float64)


def _cells(text: str, before: str, after: str) -> np.ndarray:
    c = np.frombuffer((before + text + after).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.zeros(0, np.int64)
    c = np.where(letter, c, np.uint32(32))
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    c = c[kept].astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)


def train(rows: DataFrame, fan: int = bloom.FAN) -> Model:
    """Model of ``rows`` (lang, text), all of them.

    A task's counts travel in slices of cells, and the slices of all tasks are merged in two steps.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in slices(batches, "text"):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                h, n = trigrams(text)
                own = found.setdefault(lang, np.zeros(CELLS, np.int64))
                own += np.bincount(h, weights=n, minlength=CELLS).astype(np.int64)
        task = bloom.task_number()
        for lang, counts in found.items():
            parts = counts.reshape(-1, _SLICE)
            yield table({"key": [lang] * len(parts), "part": range(len(parts)), "task": [task] * len(parts), "content": [x.tobytes() for x in parts]}, bloom.PIECE_TYPES)

    counted: dict[str, np.ndarray] = {}
    merged = bloom.merge_pieces(rows.select("lang", "text").mapInArrow(count, bloom.PIECES), np.add, np.int64, fan)
    for r in merged.collect():  # CELLS numbers per language
        counted.setdefault(r.key, np.zeros(CELLS, np.int64)).reshape(-1, _SLICE)[r.part] = np.frombuffer(r.content, np.int64)
    found = sorted(counted.items(), key=lambda item: item[0])
    found = [(name, n) for name, n in found if n.any()]
    if not found:
        return Model([], np.zeros((CELLS, 0)))
    n = np.stack([c for _, c in found], axis=1) + 0.05
    return Model([name for name, _ in found], np.log(n / n.sum(axis=0)).astype(np.float32))


def fit(cells: np.ndarray, weight: np.ndarray, log_p: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """The chosen languages and their shares, the largest first."""
    total = weight.sum()
    logs = log_p[cells]
    start = int(np.argmax(weight @ logs))
    if log_p.shape[1] == 1:
        return [0], np.ones(1)
    # Relative to the best language, so that no probability underflows.
    ratio = np.exp(np.minimum(logs - logs[:, start : start + 1], 60.0)).astype(np.float64)
    chosen, share, price = [start], np.ones(1), penalty * np.log(total + 1)
    mixed, reached = np.ones(len(cells)), 0.0
    while len(chosen) < log_p.shape[1]:
        slope = (weight / mixed) @ ratio / total
        slope[chosen] = 0
        new = int(np.argmax(slope))
        if total * np.log(max(slope[new], 1.0)) <= price:
            break
        tried = ratio[:, [*chosen, new]]
        part = np.append(share * 0.9, 0.1)
        for _ in range(ROUNDS):
            m = tried @ part
            last, part = part, part * ((weight / m) @ tried) / total
            if np.abs(part - last).max() < 1e-4:
                break
        m = tried @ part
        gained = float(weight @ np.log(m))
        if gained - reached <= price:
            break
        chosen, share, mixed, reached = [*chosen, new], part, m, gained
    order = sorted(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
    return [chosen[i] for i in order], share[order]


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.where(F.col(id_col).isNotNull() & ~is_held_out(id_col))
    return rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()


def _predict(text: str | None, model: Model, penalty: float) -> tuple[str, float, list[str], list[float]]:
    if text is not None and model.names:
        cells, weight = trigrams(text)
        if len(cells):
            chosen, share = fit(cells, weight, model.log_p, penalty)
            names = [model.names[i] for i in chosen]
            return names[0], min(1.0, float(share[0])), names, [float(s) for s in share]
    return UNKNOWN, 0.0, [], []


def identify(
    docs: DataFrame, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per document: whether it was held out of training, the main language, its share as the score,
    and all chosen languages with their shares."""
    model = docs.sparkSession.sparkContext.broadcast(train(_training_rows(docs, id_col, text_col, lang_col)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    types = {
        "doc_id": pa.int64(),
        "held_out": pa.bool_(),
        "lang_pred": pa.string(),
        "score": pa.float64(),
        "languages": pa.list_(pa.string()),
        "shares": pa.list_(pa.float64()),
    }

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [_predict(t, model.value, penalty) for t in b.column("text").to_pylist()]
            columns = dict(zip(["lang_pred", "score", "languages", "shares"], zip(*found))) if found else dict.fromkeys(list(types)[2:], [])
            yield table({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), **{k: list(v) for k, v in columns.items()}}, types)

    schema = "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>"
    return rows.mapInArrow(scan, schema)


def keep_known(
    docs: DataFrame, languages: list[str] | None = None, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The input's rows whose main language is known (and, if given, one of ``languages``)."""
    model = docs.sparkSession.sparkContext.broadcast(train(_training_rows(docs, id_col, text_col, lang_col)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            found = [_predict(t, model.value, penalty)[0] for t in b.column(text_col).to_pylist()]
            yield b.filter(pa.array([x != UNKNOWN and (languages is None or x in languages) for x in found], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
