import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import alnum, awkward, prose
from trackloom.llm import words
from trackloom.llm.words import ALNUM, BLANKS, utf8, windows, words_of

TEXT = st.text(alphabet=st.sampled_from(list("abAZz09 ._\n\téß日{}/:")), max_size=60)


def split(texts, kind):
    w = words_of(*utf8(pa.array(texts, pa.string())), kind)
    return w, [[w.text(i, i + 1).decode() for i in range(a, b)] for a, b in zip(w.first, w.first[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w, got = split(texts, ALNUM)
    from tests.llm.cases import fold

    assert [[fold(x) for x in own] for own in got] == [alnum(t) for t in texts]
    assert split(texts, BLANKS)[1] == [[x.decode() for x in (t or "").encode().split()] for t in texts]


def test_hash_follows_the_word_and_nothing_else():
    texts = [t for _, t in awkward()] + [prose(k, 500) for k in range(20)]
    w, own = split(texts, ALNUM)
    seen = {}
    for h, x in zip(w.hash.tolist(), [fold_ for t in texts for fold_ in alnum(t)]):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_segments_do_not_change_words(monkeypatch):
    texts = [prose(1, 4000), "", prose(2, 3), "x" * 9000 + " y", prose(3, 2000)]
    whole, _ = split(texts, ALNUM)
    monkeypatch.setattr(words, "SEGMENT", 512)
    parts, _ = split(texts, ALNUM)
    assert (whole.start == parts.start).all() and (whole.end == parts.end).all() and (whole.hash == parts.hash).all()


def test_windows_stay_in_their_document():
    w, _ = split(["a b c d", "", "x y", "p q r"], ALNUM)
    at, end, h1, h2 = windows(w, 3)
    assert list(zip(at, end)) == [(0, 3), (1, 4), (6, 9)]
    at, end, _, _ = windows(w, 3, whole_short=True)
    assert list(zip(at, end)) == [(0, 3), (1, 4), (4, 6), (6, 9)]
    w2, _ = split(["z b c d"], ALNUM)
    assert windows(w2, 3)[2][1] == h1[1] and windows(w2, 3)[3][1] == h2[1]
