import gzip
import random
import zlib

import pytest

from trackloom.llm.warc import Gap, Record, digest_of, member, payload_of, read_archives, record, salvage, write_archives

PAGES = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>two ü 日</p>"),
    (3, "http://a/3", "<p>one</p>"),
    (4, None, "<p>one</p>"),
    (5, "http://a/5\r\nX-Page-ID: 77", ""),
    (6, "", None),
    (7, "http://a/7", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"),
    (8, "http://a/8", "x" * 300_000),
    (9, "http://a/9", "\x1f\x8b\x08 \x00 line\n"),
    (None, "http://a/none", "<p>one</p>"),
    (10, "http://a/10", "<p>twice</p>"),
    (10, "http://a/10", "<p>twice</p>"),
    (11, "http://a/11", "<p>twice</p>"),
]


def expected(pages, least=0):
    out = []
    for p, _, html in pages:
        data = (html or "").encode()
        same = [q for q, _, h in pages if q is not None and (h or "").encode() == data]
        kept = max(same) if same and p is not None and len(data) >= least else p
        out.append((p, len(data), digest_of(data), "response" if p == kept else "revisit", None if p == kept else kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 11])
def test_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS value", "2 AS sha", "3 AS k64", "4 AS kept")
    path = f"file://{tmp_path}/out"
    write_archives(pages.repartition(3), path, min_revisit_bytes=least, records_per_file=2)
    got = read_archives(spark, path).collect()
    assert all(r.gap_reason is None for r in got)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(PAGES, least)
    html = {p: (h or "").encode() for p, _, h in PAGES}
    assert all(bytes(r.payload) == html.get(r.page_id, b"<p>one</p>") for r in got if r.record_type == "response")
    for f in (tmp_path / "out").glob("part-*"):  # ordinary gzip for any reader
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_empty_table(spark, tmp_path):
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/out")
    assert read_archives(spark, f"file://{tmp_path}/out").count() == 0


def records(n=12):
    return [record(k, f"http://x/{k}", (f"<p>{k}</p>" * (k * 7 + 1)).encode(), None, "2000-01-01T00:00:00Z") for k in range(n)]


def ids(found):
    return [int(x.headers.get("x-page-id", -1)) for x in found if isinstance(x, Record)]


def test_gzip_members_after_damage_are_recovered():
    parts = [member(r) for r in records()]
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    data = bytearray(b"".join(parts))
    data[starts[3] + 40] ^= 255
    data[starts[7]] = 0
    found = list(salvage(bytes(data)))
    assert ids(found) == [0, 1, 2, 4, 5, 6, 8, 9, 10, 11]
    gaps = [x for x in found if isinstance(x, Gap)]
    assert (gaps[0].start, gaps[0].end) == (starts[3], starts[4])
    assert gaps[1].end == starts[8] and starts[7] <= gaps[1].start <= starts[7] + 1


def test_cut_file_and_garbage_between():
    parts = [member(r) for r in records()]
    data = b"junk\x1f\x8b\x08junk" + b"".join(parts[:4]) + b"WARC/1.1\r\nbroken" + b"".join(parts[4:9]) + parts[9][:-9]
    found = list(salvage(data))
    assert ids(found) == list(range(10)) and [x.sound for x in found if isinstance(x, Record)] == [True] * 9 + [False]
    gaps = [(x.start, x.end) for x in found if isinstance(x, Gap)]
    assert gaps[0] == (0, 11) and gaps[-1] == (len(data) - len(parts[9]) + 9, len(data)) and len(gaps) == 3


def test_plain_records_with_wrong_lengths_and_digests():
    parts = records()
    parts[2] = parts[2].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    parts[5] = parts[5].replace(b"<p>5</p>", b"<p>X</p>", 1)
    parts[8] = parts[8].replace(b"WARC/1.1", b"WARC/9.9", 1)
    found = list(salvage(b"".join(parts)))
    assert ids(found) == [0, 1, 3, 4, 6, 7, 9, 10, 11]
    assert {x.reason for x in found if isinstance(x, Gap)} >= {"block digest differs"}
    inside = list(salvage(gzip.compress(b"".join(parts))))
    assert ids(inside) == ids(found) and any(isinstance(x, Gap) for x in inside)


def test_every_single_damaged_byte_loses_at_most_one_record():
    parts = [member(r) for r in records(4)]
    data = b"".join(parts)
    rng = random.Random(5)
    for at in rng.sample(range(len(data)), 120):
        broken = bytearray(data)
        broken[at] ^= 1 << rng.randrange(8)
        found = list(salvage(bytes(broken)))
        assert len(set(ids(found)) & set(range(4))) >= 3
        covered = sum(x.end - x.start for x in found if isinstance(x, Gap))
        assert covered <= max(map(len, parts)) + 1


def test_members_end_in_a_zero_byte():
    for size in (0, 10, (1 << 24) + 3):
        m = member(b"a" * size)
        assert m[-1] == 0 and gzip.decompress(m) == b"a" * size
    assert payload_of(b"HTTP/1.1 200 OK\r\n\r\nx") == b"x" and zlib.crc32(b"") == 0


def test_archives_of_any_name_are_read(spark, tmp_path):
    from trackloom.llm import warc

    one = warc.record(1, "http://a/", b"one", None, "2000-01-01T00:00:00Z")
    two = warc.record(2, "http://b/", b"two", None, "2000-01-01T00:00:00Z")
    (tmp_path / "CC-MAIN-1.warc.gz").write_bytes(warc.member(one))
    (tmp_path / "other.warc").write_bytes(two)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = {(r.page_id, bytes(r.payload), r.gap_reason) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == {(1, b"one", None), (2, b"two", None)}


def test_a_member_of_zeros_is_a_gap():
    parts = [member(r) for r in records()]
    starts = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
    data = bytearray(b"".join(parts))
    data[starts[4] : starts[5]] = bytes(starts[5] - starts[4])
    found = list(salvage(bytes(data)))
    assert ids(found) == [0, 1, 2, 3, *range(5, 12)]
    assert [(x.start, x.end) for x in found if isinstance(x, Gap)] == [(starts[4], starts[5])]


def test_records_before_the_damage_in_one_member_are_kept():
    plain = records(20)
    data = bytearray(gzip.compress(b"".join(plain), 1))
    data[len(data) * 3 // 4] ^= 255
    found = list(salvage(bytes(data)))
    kept = ids(found)
    assert kept[:10] == list(range(10)) and kept == sorted(set(kept)) and not any(x.sound for x in found if isinstance(x, Record))
    gaps = [x for x in found if isinstance(x, Gap)]
    assert gaps[-1].end == len(data) and "after" in gaps[-1].reason
    # A wrong checksum alone loses nothing whose digest holds.
    data = bytearray(gzip.compress(b"".join(plain)))
    data[-6] ^= 255
    assert ids(list(salvage(bytes(data)))) == list(range(20))


def test_gaps_inside_a_member_say_where():
    plain = records()
    starts = [sum(map(len, plain[:k])) for k in range(len(plain) + 1)]
    broken = bytearray(b"".join(plain))
    broken[starts[3] : starts[3] + 4] = b"XXXX"
    gap = next(x for x in salvage(gzip.compress(bytes(broken))) if isinstance(x, Gap))
    assert (gap.inner_start, gap.inner_end) == (starts[3], starts[4])
