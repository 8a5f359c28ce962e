"""WARC archives: round trip of bytes, segments, revisits."""

import base64
import glob
import gzip
import hashlib

from palimpsest.llm import warc
from palimpsest.llm.common import shared_path

SCHEMA = "page_id long, url string, html string, value string"
BIG = "".join(f"<p>{i} ü</p>\r\n" for i in range(9000))
NASTY = "WARC/1.1\r\nx: y\r\n\r\nWARC/1.1\r\nx\r\n\r\nWARC/1.1\r\n\r\n"
ROWS = [
    (4, "http://a/1", "<b>same</b>", "v"),
    (2, "http://a/2", "<b>same</b>", None),
    (9, "http://a/3", "<b>same</b>", "v"),
    (1, "http://a/ 4\n", BIG, "v"),
    (3, None, None, "v"),
    (5, "http://a/5", "", "v"),
    (6, "x", NASTY, "v"),
    (7, "x", BIG + NASTY + BIG, "v"),
    (8, "x", NASTY * 40, "v"),
    (12, "r", "twice", "v"),
    (12, "r", "twice", "v"),
    (None, "n", "no id", "v"),
]


def test_round_trip(spark):
    path = shared_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).repartition(2), path, chunk_bytes=1000)
    chunks = warc.read_chunks(spark, path).collect()
    assert max(len(c.payload) for c in chunks) <= 1100
    built = {}
    for c in sorted(chunks, key=lambda c: (c.record_id, c.chunk_no)):
        built[c.record_id] = built.get(c.record_id, b"") + bytes(c.payload)
    ends = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.records(warc.read_chunks(spark, path)).collect()), key=str)
    first = {}
    for i, _, html, _ in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", i)
    want = []
    for i, _, html, _ in ROWS:
        raw, to = (html or "").encode(), first.get(html or "")
        revisit = to is not None and to != i
        want.append((f"urn:page:{i}", "revisit" if revisit else "response", f"urn:page:{to}" if revisit else None, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()))
        if not revisit and i != 12:
            assert built[f"urn:page:{i}"] == raw
    assert ends == sorted(want, key=str)


def test_files_are_warc(spark):
    path = shared_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(ROWS[:2], SCHEMA).coalesce(1), path)
    raw = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{path}/*.gz")))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")
    assert raw.count(b"WARC-Record-ID") == 2


def test_empty(spark):
    path = shared_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_chunks(spark, path).count() == 0


def test_smaller_payloads_stay_responses(spark):
    path = shared_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(ROWS[:3], SCHEMA), path, min_bytes=100)
    assert {r.record_type for r in warc.read_chunks(spark, path).collect()} == {"response"}


def test_foreign_files(spark, tmp_path):
    def record(version, kind, rid, block, *more):
        head = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", *more, f"content-length:{len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    odd = b"<p>\r\n\r\nWARC/1.0\r\nno record</p>"
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    raw = record("1.0", "warcinfo", "urn:i", b"software: y\r\n", "Content-Type: application/warc-fields")
    raw += record("1.0", "response", "urn:a", http + odd, "Content-Type: application/http; msgtype=response", "WARC-Target-URI: http://a/")
    raw += record("1.1", "resource", "urn:b", b"plain", "Content-Type: text/plain")
    with gzip.open(tmp_path / "x.warc.gz", "wb") as f:
        f.write(raw)
    got = {r.record_id: r for r in warc.read_chunks(spark, str(tmp_path)).collect()}
    assert [bytes(got[r].payload) for r in ("urn:i", "urn:a", "urn:b")] == [b"software: y\r\n", odd, b"plain"]
    assert got["urn:a"].digest == base64.b32encode(hashlib.sha1(odd).digest()).decode() and got["urn:a"].target_uri == "http://a/"
    assert got["urn:b"].record_type == "resource" and all(r.last for r in got.values())
