"""WARC archives written from and read back as a chunked record table.

A payload longer than ``chunk_bytes`` is written as WARC segments (a first record and
``continuation`` records), so that reading yields rows of record identifier and chunk number and
nothing ever holds a whole long record again.  Each row carries the digest of the payload up to its
end; the last one's is the digest of the whole.  Files are ordinary ``.gz`` WARC/1.1 files, written
and read by Spark's own text source, so any file system that Spark knows will do.  Gzip files aren't
split, so a record's segments, written one after the other, are read by one task in their order.

Other writers' WARC/1.0 and 1.1 files are read as well, record by record as they wrote them: fields
that only this writer sets are checked where they are.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import shared_path

CHUNK_BYTES = 256 * 1024
#: What stands between two records' blocks.  A block that holds it is cut there, so a reader never takes it for one.
MARK = b"\r\n\r\nWARC/1."
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = "record_id string, chunk_no int, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, digest string, last boolean"


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _segments(block: bytes, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of the block's segments: at most ``size`` bytes, none holding MARK."""
    begin, hit = 0, block.find(MARK)
    while True:
        end = min(begin + size, len(block))
        if hit >= 0 and hit + 6 <= end:  # cut inside the mark
            end = hit + 6
            hit = block.find(MARK, end)
        yield begin, end
        begin = end
        if begin >= len(block):
            return


def _safe_uri(uri: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "")


def _write_rows(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page_id, url, payload, n, sha, first in zip(*[c for c in batch.columns], strict=True):
                payload, n, first = payload.as_py() or b"", n.as_py(), first.as_py()
                rid, digest = f"urn:page:{page_id.as_py()}", _b32(bytes.fromhex(sha.as_py()))
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
                block = http if first is not None else http + payload
                state = hashlib.sha1()
                spans = list(_segments(block, chunk_bytes + len(http)))
                for k, (a, b) in enumerate(spans, 1):
                    part = block[a:b]
                    state.update(block[max(a, len(http)) : b])
                    head = [f"WARC-Type: {'continuation' if k > 1 else 'revisit' if first is not None else 'response'}", f"WARC-Record-ID: <{rid}{f':{k}' if k > 1 else ''}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_safe_uri(url.as_py())}"]
                    if first is not None:
                        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
                    if k == 1:
                        head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
                    else:
                        head.append(f"WARC-Segment-Origin-ID: <{rid}>")
                    if len(spans) > 1:
                        head.append(f"WARC-Segment-Number: {k}")
                        if k == len(spans):
                            head.append(f"WARC-Segment-Total-Length: {len(block)}")
                    head += [f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(part).digest())}", f"X-Digest-So-Far: sha1:{_b32(state.digest())}", f"Content-Length: {len(part)}"]
                    out.append(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + part)
                    held += len(out[-1])
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, record: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> None:
    """One WARC record per row; of equal payloads of at least ``min_bytes``, the smallest id's is the response.

    The other rows of the group become revisit records that refer to it.  Null payloads are empty;
    a null id is written as such and never referred to; rows repeated with the same id and payload
    are alike (all responses, or all revisits).  Extra columns are ignored; an empty table writes
    an archive without records.
    """
    rows = pages.select(F.col(record).cast("long").alias("id"), F.col(url).cast("string").alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"n": F.octet_length("payload").cast("long"), "sha": F.sha1("payload")})
    # payloads stay where they are while the digests meet
    firsts = rows.where((F.col("n") >= min_bytes) & F.col("id").isNotNull()).groupBy("sha").agg(F.min("id").alias("first"))
    others = rows.select("id", "sha", "n").where(F.col("n") >= min_bytes).join(firsts, "sha").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "sha", "first").distinct()
    others = others.toDF("oid", "osha", "first")
    typed = rows.join(others, F.col("id").eqNullSafe(F.col("oid")) & (F.col("sha") == F.col("osha")), "left")
    typed = typed.select("id", "uri", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"), "n", "sha", "first")
    records = typed.mapInArrow(_write_rows(chunk_bytes), "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _head(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields by lower-case name, and the block as far as it is there."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in fields}, block


def _bare(uri: str) -> str:
    return uri.strip("<>")


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records between marks; one whose block holds a mark itself is put together again."""
    held = None
    for batch in batches:
        for value in batch.column(0):
            held = value.as_py() if held is None else held + MARK + value.as_py()
            fields, block = _head(held)
            size = int(fields["content-length"])
            if len(block) >= size:
                yield fields, block[:size]
                held = None
    if held is not None:
        raise ValueError("the last record is cut")


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())])
    state, record, kind, whole, refers, given, seen, number = hashlib.sha1(), None, None, None, None, None, 0, 0
    out, held = [], 0
    for fields, block in _whole_records(batches):
        name = fields["warc-record-id"]
        if fields.get("warc-block-digest", "").startswith("sha1:") and f"sha1:{_b32(hashlib.sha1(block).digest())}" != fields["warc-block-digest"]:
            raise ValueError(f"{name}: block differs from its digest")
        if fields["warc-type"] != "continuation":
            http, cut, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
            if http and not cut:
                payload = b""
            record, kind, state, seen, number = _bare(name), fields["warc-type"], hashlib.sha1(), 0, 0
            length = re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)
            whole = int(length[1]) if length else None
            refers = _bare(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
            given = fields.get("warc-payload-digest")
        else:
            payload = block
            if _bare(fields["warc-segment-origin-id"]) != record:
                raise ValueError(f"{name}: its first segment isn't before it")
        if int(fields.get("warc-segment-number", 1)) != number + 1:
            raise ValueError(f"{name}: segment {number + 1} is missing")
        state.update(payload)
        seen, number = seen + len(payload), number + 1
        sofar = f"sha1:{_b32(state.digest())}"
        own = "x-digest-so-far" in fields
        if own and sofar != fields["x-digest-so-far"]:
            raise ValueError(f"{name}: payload differs from its running digest")
        last = "warc-segment-number" not in fields or "warc-segment-total-length" in fields
        if own and last and kind == "response" and (sofar != given or seen != whole):
            raise ValueError(f"{name}: payload differs from its digest")
        revisit = kind == "revisit"
        out.append((record, number - 1, kind, fields.get("warc-target-uri"), refers, payload, whole if revisit else seen, (given or "").removeprefix("sha1:") if revisit else sofar.removeprefix("sha1:"), last))
        held += len(block)
        if held > 4_000_000:
            yield _batch(out, schema)
            out, held = [], 0
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives as rows of record and chunk number.

    payload is the chunk's bytes; payload_bytes and digest (base32 SHA-1) cover the payload up to
    the chunk's end, in the row marked ``last`` all of it; a revisit has one row, without payload
    and with the length and digest of the payload it stands for.
    """
    text = spark.read.option("lineSep", MARK.decode()).text(path, recursiveFileLookup=True)
    return text.where("value <> ''").select(F.col("value").cast("binary").alias("value")).mapInArrow(_read_rows, CHUNK_SCHEMA)


def records(chunks: DataFrame) -> DataFrame:
    """One row a record, from its last chunk; no shuffle."""
    return chunks.where("last").select("record_id", "record_type", "target_uri", "refers_to", "payload_bytes", F.col("digest").alias("payload_digest"), (F.col("chunk_no") + 1).alias("chunks"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages to archives and back."""
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")  # noqa: E731  after urn:page:
    return records(read_chunks(spark, path)).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


# base32 of the hex digest: five hex digits are four letters
ORACLE = r"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
v as (select page_id, html, list_transform(range(0, 8), lambda g: list_reduce(list_transform(range(1, 6), lambda d: (instr('0123456789abcdef', h[5 * g + d]) - 1)::bigint), lambda a, b: a * 16 + b)) as v from p),
f as (select html, min(page_id) as first from p group by html)
select page_id, strlen(v.html)::bigint as payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([32768, 1024, 32, 1], lambda w: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[x // w % 32 + 1]), '')), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from v join f on v.html = f.html
"""
