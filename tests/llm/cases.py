"""Small tables with the awkward rows, and plain versions of the text helpers."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ID_TEXT = "doc_id long, text string, lang string, source string, n_chars long"


def fold(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def alnum(text: str | None) -> list[str]:
    return WORD.findall(fold(text or ""))


def made_words(rng: random.Random, n: int) -> list[str]:
    part = ["an", "er", "thé", "on", "in", "ßt", "re", "ou", "ñi", "st"]
    return ["".join(rng.choices(part, k=rng.randint(1, 4))) for _ in range(n)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for i, w in enumerate(made_words(rng, n)):
        out.append(w.capitalize() if i % 9 == 0 else w)
        out.append(rng.choice([" ", " ", " ", ", ", ".\n"]))
    return "".join(out).strip()


def documents(spark, rows):
    """Rows (doc_id, text) with the other columns of the documents table, some of them null."""
    full = [(i, t, None if i is None or i % 3 == 0 else "en", None if t is None else "src0", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, ID_TEXT)


def awkward(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Null and empty texts, one long text, copies, near copies, repeated rows, and a row without an id."""
    base = [prose(seed * 100 + k, 120) for k in range(8)]
    near = base[0].split(" ")
    near[60] = "andere"
    shared = prose(999, 70)
    rows = [
        (1, None),
        (2, ""),
        (3, "  \n\t \n"),
        (4, "!!! ... ###"),
        (5, "one"),
        (6, base[0]),
        (7, base[0]),
        (8, " ".join(near)),
        (9, base[1] + " " + shared),
        (10, base[2] + "\n" + shared + "\n" + base[3]),
        (11, prose(5, 30_000)),
        (12, base[4]),
        (12, base[4]),
        (None, base[0]),
        (13, base[5].upper()),
        (14, base[5]),
        (15, "\n".join([base[6], base[6], base[7]])),
        (16, shared),
        (17, "日本語 のテキスト " * 40),
    ]
    return rows
