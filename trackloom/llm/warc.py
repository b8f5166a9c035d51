"""WARC archives written and read by Spark, with a reader that survives damage.

Every record is a gzip member of its own.  Spark's text writer puts the members into files: a member ends in
a zero byte (the top byte of its length; a record of 16 MB or more is followed by an empty member, which ends
in one too), and the zero is the writer's line separator.  So the files are ordinary ``.warc.gz`` data in any
store that Spark can write to, and a lost task is written again like any other.

The reader takes whole files from Spark, checks every record (gzip checksum, version line, lengths, digests),
and where a check fails looks for the next gzip member or version line that starts a valid record.  The bytes
between are logged as a quarantined gap; later records are recovered.  Of a member that breaks off or whose
checksum fails, what can be inflated is searched, too, and records whose stated digests hold are kept and
marked: their headers aren't covered by a digest (column ``sound``).  Zero
bytes between members are a gap like any others.  A file is one row and is read by one task (Spark's limit for
one row is 2 GB), which is why ``write_archives`` bounds the records of a file.

Defined results: null html is an empty payload; a page without an id is always a response, and no record
refers to it; of equal payloads that with the largest id is the response (all rows that repeat this id), the
others revisit it; null urls leave the header out; control characters in urls are percent-encoded.  The
result has fixed columns, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import bloom
from trackloom.llm.words import slices, table

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 5
#: Equal payloads of fewer bytes are all responses.
MIN_REVISIT_BYTES = 0
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_MEMBER = b"\x1f\x8b\x08"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.sha256(f"{page_id} {digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-4{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit has the payload's headers and digest, but not the payload."""
    digest = digest_of(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("X-Page-ID", page_id),
    ]
    if refers_to is not None:
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to)]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as one gzip member that ends in a zero byte."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY


def _empty() -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.flush()


_EMPTY = _empty()


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    date: str = "2000-01-01T00:00:00Z",
    records_per_file: int = 2_000,
) -> None:
    """Write one record per page.  Only payloads that occur more than once are shuffled."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    ).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    k64 = F.conv(F.substring("sha", 1, 16), 16, -10).cast("long")
    long_enough = F.octet_length("html") >= min_revisit_bytes
    repeated = (
        rows.where(long_enough)
        .groupBy("sha")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1 AND kept IS NOT NULL")
        .select("sha", "kept")
    )
    may_repeat, single = bloom.split(rows.withColumn("k64", k64), "k64", bloom.bit_map(repeated.select(k64)))
    met = may_repeat.join(repeated, "sha", "left")
    refers = F.when(F.col("page_id") != F.col("kept"), F.col("kept")).alias("refers_to")
    parts = met.select("page_id", "url", "html", refers).unionByName(single.select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")]
            yield table({"value": [member(record(p, u, h.encode(), r, date))[:-1] for p, u, h, r in zip(*columns)]}, {"value": pa.binary()})

    # The cast takes the bytes as they are; the separator adds the last one.
    packed = parts.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)


@dataclass
class Record:
    offset: int
    kind: str
    headers: dict[str, str] = field(repr=False)
    block: bytes = field(repr=False)
    #: Whether everything about it is checked; of a damaged member only the block or payload is, by its digest.
    sound: bool = True


@dataclass
class Gap:
    """Bytes of the file that hold no record; of a member, where in the inflated data they are."""

    start: int
    end: int
    reason: str
    inner_start: int | None = None
    inner_end: int | None = None


class Damaged(Exception):
    pass


def _plain(data: bytes, at: int, offset: int) -> tuple[Record, int]:
    """The record that starts at ``at``, checked, and the place after it."""
    if not _VERSION_LINE.match(data, at):
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        raise Damaged("header without an end")
    headers = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdecimal():
        raise Damaged("no length")
    start = head_end + 4
    end = start + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length does not meet the end of the record")
    block = data[start:end]
    kind = headers.get("warc-type", "")
    _check_digest(headers.get("warc-block-digest"), block, "block")
    if kind == "response":
        _check_digest(headers.get("warc-payload-digest"), payload_of(block), "payload")
    return Record(offset, kind, headers, block), end + 4


def _check_digest(stated: str | None, data: bytes, what: str) -> None:
    if stated and stated.lower().startswith("sha1:") and stated[5:].upper() != digest_of(data):
        raise Damaged(f"{what} digest differs")


def payload_of(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    return body if found else block


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Content of the member at ``at``, the place after it, and what is wrong with it ("" if nothing)."""
    z = zlib.decompressobj(31)
    try:
        # The copy is bounded by the file; a view would keep it alive in the object.
        out = z.decompress(memoryview(data)[at:])
        return (out, len(data) - len(z.unused_data), "") if z.eof else (out, len(data), "gzip: cut off")
    except zlib.error as e:
        return _up_to_damage(data, at), len(data), f"gzip: {e}"


def _up_to_damage(data: bytes, at: int, step: int = 64) -> bytes:
    """What can be inflated of a damaged member, read in small steps."""
    z, out = zlib.decompressobj(31), []
    while at < len(data) and not z.eof:
        before = z.copy()
        try:
            out.append(z.decompress(data[at : at + step]))
            at += step
        except zlib.error:
            if step == 1:
                break
            z, step = before, 1
    return b"".join(out)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All valid records of a file, and the gaps between them, in order.

    Offsets are those of the file; records inside one gzip member share the member's offset.
    """
    at, gap_start, reason = 0, None, ""
    while at < len(data):
        kept: list[Record | Gap] = []
        try:
            if data.startswith(_MEMBER, at):
                inner, after, wrong = _inflate(data, at)
                kept = list(_inner(inner, at, not wrong))
                if wrong:
                    raise Damaged(wrong)
            else:
                one, after = _plain(data, at, at)
                kept = [one]
        except Damaged as e:
            if any(isinstance(x, Record) for x in kept):
                # A member that begins well: its own gap starts behind the last record that holds.
                if gap_start is not None:
                    yield Gap(gap_start, at, reason)
                yield from kept
                gap_start, reason = at, f"{e}, after {sum(isinstance(x, Record) for x in kept)} records"
            elif gap_start is None:
                gap_start, reason = at, str(e)
            at = _next_start(data, at + 1)
            continue
        if gap_start is not None:
            yield Gap(gap_start, at, reason)
            gap_start = None
        yield from kept
        at = after
    if gap_start is not None:
        yield Gap(gap_start, len(data), reason)


def _inner(data: bytes, offset: int, sound: bool = True) -> Iterator[Record | Gap]:
    """Records of one member, which may hold several; gaps tell where in its content they are.

    Of a member that isn't ``sound`` only records with a digest that holds are taken, and there is no gap
    behind the last.
    """
    at, start, reason = 0, 0, ""
    if sound and data and not any(_VERSION_LINE.finditer(data)):
        raise Damaged("member without a record")
    while at < len(data):
        try:
            found, after = _plain(data, at, offset)
            if not sound:
                _check_unsound(found)
        except Damaged as e:
            if not reason:
                start, reason = at, str(e)
            following = _VERSION_LINE.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if reason:
            yield Gap(offset, offset, f"inside a member: {reason}", start, at)
            reason = ""
        yield found
        at = after
    if reason and sound:
        yield Gap(offset, offset, f"inside a member: {reason}", start, len(data))


def _check_unsound(found: Record) -> None:
    """What a record of a damaged member has to have: a digest, which holds, and unchanged names where they can be told."""
    h = found.headers
    found.sound = False
    if not ({"warc-block-digest", "warc-payload-digest"} & set(h)) or not {"warc-type", "warc-record-id", "warc-date"} <= set(h):
        raise Damaged("incomplete headers in a damaged member")
    page, digest = h.get("x-page-id", ""), h.get("warc-payload-digest", "").partition(":")[2]
    if re.fullmatch(r"-?\d+", page) and h["warc-record-id"] != _record_id(int(page), digest):
        raise Damaged("ids that don't fit in a damaged member")


def _next_start(data: bytes, at: int) -> int:
    """The next place where a gzip member or a version line may start."""
    line = _VERSION_LINE.search(data, at)
    places = [p for p in (data.find(_MEMBER, at), line.start() if line else -1) if p >= 0]
    return min(places, default=len(data))


_FIELDS = {
    "file": pa.string(),
    "offset": pa.int64(),
    "gap_end": pa.int64(),
    "gap_reason": pa.string(),
    "inner_start": pa.int64(),
    "inner_end": pa.int64(),
    "record_type": pa.string(),
    "sound": pa.bool_(),
    "page_id": pa.int64(),
    "url": pa.string(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "refers_to": pa.int64(),
    "payload": pa.binary(),
}
_SCHEMA = (
    "file string, offset long, gap_end long, gap_reason string, inner_start long, inner_end long, record_type string, sound boolean, page_id long, url string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def _row(file: str, x: Record | Gap, with_payload: bool) -> tuple:
    if isinstance(x, Gap):
        return (file, x.start, x.end, x.reason, x.inner_start, x.inner_end, *[None] * 8)
    h = x.headers
    number = lambda name: int(h[name]) if re.fullmatch(r"-?\d+", h.get(name, "")) else None
    payload: bytes | None = payload_of(x.block)
    if x.kind == "revisit":
        length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", x.block)
        size, payload = (int(length[1]) if length else None), None
        digest = h.get("warc-payload-digest", "").partition(":")[2] or None
    else:
        size, digest = len(payload), digest_of(payload)
    return (file, x.offset, None, None, None, None, x.kind, x.sound, number("x-page-id"), h.get("warc-target-uri"), size, digest, number("x-refers-to-page-id"), payload if with_payload else None)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record and one per quarantined gap (``gap_reason`` is set there) of the files in ``path``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content")):
                out = []
                for x in salvage(content.as_py()):
                    out.append(_row(file, x, with_payload))
                    if len(out) >= 200:
                        yield table(dict(zip(_FIELDS, map(list, zip(*out)))), _FIELDS)
                        out = []
                if out:
                    yield table(dict(zip(_FIELDS, map(list, zip(*out)))), _FIELDS)

    files = spark.read.format("binaryFile").load(path)  # names that begin with _ or . are left out by Spark
    return files.select("path", "content").mapInArrow(scan, _SCHEMA)
