"""Archives written and read back, and what a reader makes of damaged ones."""

import base64
import gzip
import hashlib
import io

import pytest

from bizlake.llm import warc
from bizlake.session import fresh_path

SCHEMA = "page_id long, url string, html string, keep long, sha256 string"


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], SCHEMA)


def _cycle(spark, rows, min_bytes=0, **options):
    marked = warc.mark_revisits(_pages(spark, rows), min_bytes=min_bytes)
    archives = warc.write_archives(marked, fresh_path(spark, "warc"), **options)
    return archives, warc.resolve(warc.read_archives(archives, with_payload=True)).collect()


def _sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _brute(rows, min_bytes=0):
    """(id, bytes, digest, type, refers) of every row; the first of equal largest ids is the response."""
    groups, out = {}, []
    for place, (i, _, h) in enumerate(rows):
        groups.setdefault((h or "").encode(), []).append((i is not None, i or 0, -place))
    for place, (i, _, h) in enumerate(rows):
        data = (h or "").encode()
        top = max(groups[data])
        first = len(data) < min_bytes or top == (i is not None, i or 0, -place)
        out.append((i, len(data), _sha1(data), "response" if first else "revisit", None if first or not top[0] else top[1]))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, "http://a/3", "y"), (4, None, None), (5, "http://a b/\n", ""),
    (6, "http://a/6", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"), (7, "http://a/7", "日本語 é" * 500), (8, "u", "z" * 900_000),
    (8, "u", "z" * 900_000), (8, "v", "z" * 900_000), (None, "n", "y"), (None, "n", "only"), (None, "m", "only"), (9, "q", "<p>x</p>"),
]


@pytest.mark.parametrize("min_bytes", [0, 2])
def test_round_trip(spark, min_bytes):
    archives, records = _cycle(spark, ROWS, min_bytes, archive_bytes=700)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=str)
    assert got == _brute(ROWS, min_bytes)
    assert not any(r.problem for r in records) and len({r.record_id for r in records}) == len(ROWS)
    texts = {(i, (h or "").encode()) for i, _, h in ROWS}
    assert all((r.page_id, r.payload) in texts for r in records if r.record_type == "response")
    assert archives.count() > 2 and sum(r.records for r in archives.collect()) == len(ROWS)
    assert {r.target_uri for r in records if r.page_id == 5} == {"http://a%20b/%0A"}


def test_empty_table(spark):
    archives, records = _cycle(spark, [])
    assert archives.count() == 0 and records == []


def test_any_gzip_reader_sees_the_records(spark):
    archives, _ = _cycle(spark, ROWS[:3])
    data = b"".join(gzip.decompress(warc.filesystem(r.path)[0].open_input_stream(warc.filesystem(r.path)[1], compression=None).read()) for r in archives.collect())
    assert data.count(b"WARC/1.1\r\n") == 3 and data.endswith(b"\r\n\r\n")
    assert data.count(b"WARC-Type: revisit") == 1


def _member(payload=b"hello", digest=None, length=None):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    headers = [("WARC-Type", "response"), ("Content-Type", "application/http"), ("WARC-Payload-Digest", "sha1:" + (digest or _sha1(payload)))]
    if length is None:
        return warc.member(headers, block)
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {length}\r\n\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n")


def _problems(data):
    return [r["problem"] for r in warc.records_of(io.BytesIO(data))]


def test_damaged_archives(monkeypatch):
    good = _member()
    assert _problems(b"") == [] and _problems(good * 3) == [None] * 3
    assert _problems(good + _member(digest=_sha1(b"other")) + good) == [None, "payload digest differs", None]
    for bad in (good[:-9], good[:20], b"plain text", _member(length=7), _member(length=900), gzip.compress(b"no header"), gzip.compress(b"x\r\n\r\n")):
        found = _problems(good + bad)
        assert found[0] is None and len(found) == 2 and found[1].startswith("unreadable"), bad
    flipped = bytearray(good * 2)
    flipped[len(good) + 40] ^= 0xFF
    assert _problems(bytes(flipped))[0] is None and _problems(bytes(flipped))[1]
    monkeypatch.setattr(warc, "PIECE_BYTES", 7)
    assert _problems(good * 4 + _member(b"\r\n\r\n" * 300)) == [None] * 5


def test_revisit_without_its_response(spark):
    marked = warc.mark_revisits(_pages(spark, ROWS[:2])).filter("is_revisit")
    archives = warc.write_archives(marked, fresh_path(spark, "warc"))
    assert [r.problem for r in warc.resolve(warc.read_archives(archives)).collect()] == ["no such response"]
