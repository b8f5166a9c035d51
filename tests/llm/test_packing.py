import os
import random
import subprocess
import sys
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

from tests.llm.cases import awkward, documents
from trackloom.llm.packing import Encoder, Room, best_fit, fill, pack, piece_starts, sequences
from trackloom.llm.queries import tokenizer_path
from trackloom.llm.words import utf8

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


TEXT = st.text(alphabet=st.sampled_from(list("ab'sZ09 .,\n\t \u0085\x1c　éß日{}/<|>")), max_size=50)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_pieces_give_the_ids_of_the_whole(texts):
    t = Tokenizer.from_file(PATH) if not hasattr(test_pieces_give_the_ids_of_the_whole, "t") else test_pieces_give_the_ids_of_the_whole.t
    test_pieces_give_the_ids_of_the_whole.t = t
    got = Encoder.at(PATH).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_memory_bound_does_not_change_ids(monkeypatch, plain):
    monkeypatch.setattr("trackloom.llm.packing.REMEMBERED", 20)
    monkeypatch.setattr("trackloom.llm.packing.NEW", 20)
    texts = [t or "" for _, t in awkward()]
    encoder = Encoder(PATH)
    for _ in range(4):
        assert [x + b"\1\0\0\0" for x in encoder.encode(texts)] == [plain(t).tobytes() for t in texts]
    batch = len({p for t in texts for p in t.split(" ")})
    assert len(encoder.remembered.often) <= 20 + batch and len(encoder.remembered.once) <= 20 + batch


def test_special_strings_are_what_the_tokenizer_makes_of_them(plain):
    texts = ["a <|endoftext|> b", "a  <|endoftext|>", "x<|endoftext|>y z", "<|endoftext|>", "a <|endoftext| b", "plain text"]
    got = Encoder.at(PATH).encode(texts)
    assert [x + b"\1\0\0\0" for x in got] == [plain(t).tobytes() for t in texts]
    assert len(plain(texts[0])) == 5


@given(st.lists(st.integers(1, 63), max_size=60))
@settings(max_examples=200, deadline=None)
def test_best_fit_takes_the_tightest_window(lengths):
    used, want = [], []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        room = [(64 - u, k) for k, u in enumerate(used) if 64 - u >= lengths[i]]
        if room:
            k = min(room)[1]
            same = [k for c, k in room if c == min(room)[0]]
            k = same[0]
        else:
            used.append(0)
            k = len(used) - 1
        used[k] += lengths[i]
        want.append(used[k])
    got = sorted(sum(lengths[i] for i in w) for w in best_fit(lengths, 64))
    assert got == sorted(used) and sorted(i for w in best_fit(lengths, 64) for i in w) == list(range(len(lengths)))


def test_room_finds_the_least_sufficient_capacity():
    rng, room, left = random.Random(1), Room(100), []
    for k in range(500):
        if left and rng.random() < 0.5:
            need = rng.randint(1, 100)
            got = room.take(need)
            fits = [c for c in left if c >= need]
            assert (got is None) == (not fits) and (got is None or got[0] == min(fits))
            if got:
                left.remove(got[0])
        else:
            c = rng.randint(1, 100)
            room.add(c, k)
            left.append(c)


@given(st.lists(st.integers(1, 63), max_size=40))
@settings(max_examples=200, deadline=None)
def test_filled_sequences_hold_every_id_once(lengths):
    seen = defaultdict(list)
    for s in fill(lengths, 64):
        total = sum(b - a for _, a, b in s)
        assert total <= 64 and total & (total - 1) == 0
        for i, a, b in s:
            seen[i].append((a, b))
    for i, n in enumerate(lengths):
        at = 0
        for a, b in sorted(seen[i]):
            assert a == at < b
            at = b
        assert at == n


def check(rows, got, plain):
    whole = sorted([(d, len(plain(t)), plain(t).tobytes()) for d, t in rows], key=str)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
        fits = [x for x in whole if x[0] == r.doc_id and x[1] == r.doc_tokens]
        assert any(crc32(x[2][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for x in fits)
    assert sum(r.length for r in got) == sum(x[1] for x in whole)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_pack(spark, plain):
    rows = awkward()
    docs = documents(spark, rows).selectExpr("*", "1 AS start", "2 AS ids", "3 AS sequence_id")
    check(rows, pack(docs, PATH).collect(), plain)


def test_sequences_hold_the_ids(spark, plain):
    rows = awkward()
    packed = pack(documents(spark, rows), PATH, with_ids=True)
    got = sequences(packed).collect()
    assert sum(len(r["ids"]) - r.n_pad for r in got) == sum(len(plain(t)) for _, t in rows)
    pieces = packed.collect()
    by = {r.sequence_id: r["ids"] for r in got}
    for p in pieces:
        assert by[p.sequence_id][p.offset : p.offset + p.length] == np.frombuffer(p["ids"], "<u4").tolist()


def test_empty_table(spark):
    docs = documents(spark, awkward()).limit(0)
    assert pack(docs, PATH).count() == 0 and sequences(pack(docs, PATH, with_ids=True)).count() == 0


CUT = st.lists(st.sampled_from([*"a'stré2.,( \n\t\r×ÿ·ж„—。、가\u00a0\u0085\u2009\u3000\x1f", "  ", "\n\n", " '", "'re"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(CUT, min_size=1, max_size=4))
def test_each_piece_has_the_ids_it_has_in_the_text(texts):
    t = Encoder.at(PATH).tokenizer
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    data, offsets = utf8(pa.array(texts))
    starts = [*piece_starts(data, offsets).tolist(), len(data)]
    pieces = [data[i:j].tobytes().decode() for i, j in zip(starts, starts[1:])]
    assert "".join(pieces) == "".join(texts) and set(offsets[:-1][np.diff(offsets) > 0].tolist()) <= set(starts)
    assert [i for p in pieces for i in ids(p)] == [i for x in texts for i in ids(x)]


def test_a_word_is_asked_for_once_whatever_stands_beside_it():
    encoder, asked = Encoder(PATH), []
    plain = encoder._ids
    encoder._ids = lambda pieces: asked.extend(pieces) or plain(pieces)
    encoder._ids_after_blank = encoder._ids
    encoder.encode(["one word, a word.\nThe word\nword; (word) word's end", "a word: the word! été, été."])
    encoder.encode([" word? word"])
    assert asked.count(" word") == 1 and asked.count(" été") == 1 and len(asked) == len(set(asked))


def test_a_tokenizer_of_another_pattern_gets_whole_texts(tmp_path):
    t = Tokenizer.from_file(PATH)
    t.pre_tokenizer = Sequence([Split(" ", "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
    t.save(str(tmp_path / "other.json"))
    texts = ["one, two's\n\nthree  four.", "", "x y"]
    got = Encoder(str(tmp_path / "other.json")).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_a_worker_starts_no_threads_of_the_tokenizer():
    """Each would keep memory of its own for as long as the worker lives."""
    code = """if True:
        import os, sys
        import pyarrow as pa
        from trackloom.llm.packing import Encoder
        encoder = Encoder.at(sys.argv[1])
        before = len(os.listdir("/proc/self/task"))
        encoder.encode([f"x{i} \\u4e00{i}" for i in range(3000)])
        print(len(os.listdir("/proc/self/task")) - before)
    """
    env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")} | {"PYTHONPATH": os.getcwd()}
    done = subprocess.run([sys.executable, "-c", code, PATH], env=env, capture_output=True, text=True, check=True, timeout=120)
    assert int(done.stdout.split()[-1]) == 0
