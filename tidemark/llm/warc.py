"""WARC archives: a writer that stores equal payloads once, and a reader that splits archives at any byte."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_path, materialise, ship
from . import files

MAGIC = b"\x1f\x8b\x08"
ARCHIVE_BYTES = 1 << 30
SPLIT_BYTES = 8 << 20
CHUNK = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = 0x70616765 << 96  # marks the record ids that hold a page id


def record_id(page_id: int | None, digest: str = "") -> str:
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>"
    return f"<urn:uuid:{uuid.UUID(int=PAGE | page_id & (1 << 64) - 1)}>"


def page_of(record: str | None) -> int | None:
    """The page id that a record id holds, if it holds one."""
    m = re.fullmatch(r"<urn:uuid:([0-9a-f-]{36})>", record or "")
    value = uuid.UUID(m[1]).int if m else 0
    if value >> 64 << 64 != PAGE:
        return None
    low = value & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str | None) -> str:
    """A header value: anything that would end the line is left out."""
    return re.sub(r"[\x00-\x1f\x7f]+", "", value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One gzip member: a response with the payload, or a revisit without, if it refers to another page."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest + _line(url))}",
            f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "replace") + block + b"\r\n\r\n") + packer.flush()


class Record(NamedTuple):
    start: int
    end: int
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes | None  # None if it is not kept
    payload_bytes: int
    payload_digest: str


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()}


class _Member:
    """The bytes of one gzip member, unpacked piece by piece."""

    def __init__(self, f, start: int, size: int):
        self.f, self.at, self.size = f, start, size
        self.unpack = zlib.decompressobj(31)
        self.left = b""

    def read(self) -> bytes:
        """The next bytes, none at the member's end. Raises zlib.error or EOFError if this is no whole member."""
        while not self.unpack.eof:
            if not self.left:
                if self.at >= self.size:
                    raise EOFError
                self.left = self.f.read_at(min(CHUNK, self.size - self.at), self.at)
                self.at += len(self.left)
            out = self.unpack.decompress(self.left, CHUNK)
            self.left = self.unpack.unconsumed_tail
            if out:
                return out
        return b""

    def end(self) -> int:
        return self.at - len(self.unpack.unused_data)


def _read_record(f, start: int, size: int, keep: bool) -> Record | None:
    """The record that starts at ``start``, or None if no member with a whole WARC header does."""
    member, raw = _Member(f, start, size), bytearray()
    try:
        # however long the header is, as long as the member says that it is a record
        while (more := member.read()) and bytes(raw[:5] + more[:5]).startswith(b"WARC/"[:len(raw) + len(more)]):
            seen = max(0, len(raw) - 3)
            raw += more
            if raw.find(b"\r\n\r\n", seen) >= 0:
                break
    except (zlib.error, EOFError):
        return None
    head, found, rest = (bytes(x) for x in raw.partition(b"\r\n\r\n"))
    headers = _headers(head)
    if not found or not raw.startswith(b"WARC/1.") or not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        return None
    left, http, payload, n, digest = int(headers["content-length"]), None, [], 0, hashlib.sha1()
    with_http = headers.get("content-type", "").startswith("application/http")
    http_raw = b""
    while left:
        piece = (rest or member.read())[:left]
        rest = b""
        if not piece:
            break
        left -= len(piece)
        if with_http and http is None:
            http_raw += piece
            top, found, piece = http_raw.partition(b"\r\n\r\n")
            if not found:
                continue
            http = _headers(top)
        n += len(piece)
        digest.update(piece)
        if keep:
            payload.append(piece)
    while member.read():
        pass
    return Record(start, member.end(), headers, http or {}, b"".join(payload) if keep else None, n, base64.b32encode(digest.digest()).decode())


def records(path: str, start: int, end: int, keep: bool = True) -> Iterator[Record]:
    """The records that start in ``[start, end)``; the last may reach beyond.

    The range is searched for the bytes that a gzip member begins with. A place counts if a member that begins there
    unpacks to a WARC header; then the record's own end says where the next one begins.
    """
    with files.open_random(path) as f:
        size = f.size()
        at, window, base = start, b"", start
        while at < min(end, size):
            if at < base or at + len(MAGIC) > base + len(window):
                base, window = at, f.read_at(min(CHUNK, size - at), at)
            k = window.find(MAGIC, at - base)
            if k < 0:
                at = max(at + 1, base + len(window) - len(MAGIC) + 1)
                continue
            at = base + k
            if at >= end:
                return
            found = _read_record(f, at, size, keep)
            if found is None:
                at += 1
            else:
                yield found
                at = found.end


def write_pages(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each page and return the manifest: path, bytes and records of each archive.

    Of pages with equal payloads of at least ``least_bytes``, the one with the greatest key is stored whole; the others
    refer to it. Payloads are compared by SHA-1 and length, counted before the shuffle, so a payload that many pages have
    is one row from each task. The payload is the html in UTF-8; null is empty. Pages without a key refer to a page
    that has one and never are referred to. Rows that repeat the greatest key are all stored whole. An empty table
    makes no archive.
    """
    ship(pages.sparkSession)
    folder = folder or fresh_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    slim = own.select("page", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")).filter(F.col("size") >= least_bytes)
    shared = slim.groupBy("digest", "size").agg(F.max("page").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    again = slim.join(shared, ["digest", "size"]).filter("page is null or page < first").select("page", "digest", "size", "first").distinct()
    keys = [F.coalesce("page", F.lit(0)), F.col("page").isNull(), F.sha1("payload"), F.octet_length("payload")]
    other = again.select(F.coalesce("page", F.lit(0)).alias("k0"), F.col("page").isNull().alias("k1"), F.col("digest").alias("k2"), F.col("size").alias("k3"), "first")
    rows = own.select("*", *(k.alias(f"h{i}") for i, k in enumerate(keys)))
    on = [rows[f"h{i}"] == other[f"k{i}"] for i in range(4)]
    rows = rows.join(other, on, "left").select("page", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for page, target, body, first in zip(*(batch.column(c) for c in ("page", "url", "payload", "first"))):
                if out is not None and size >= archive_bytes:
                    out.close()
                    done.append({"path": path, "bytes": size, "records": n})
                    out = None
                if out is None:
                    path, size, n = files.attempt_name(folder, ".warc.gz"), 0, 0
                    out = files.create(path)
                raw = record(page.as_py(), target.as_py(), body.as_py(), first.as_py())
                out.write(raw)
                size, n = size + len(raw), n + 1
        if out is not None:
            out.close()
            done.append({"path": path, "bytes": size, "records": n})
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return materialise(rows.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


def read_records(archives: DataFrame, *, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of the archives (path, bytes): path, offset, page_id, url, record_type, refers_to, payload_bytes,
    payload_digest and, if wanted, the payload.

    Each archive is cut into ranges of ``split_bytes`` for as many tasks. Length and digest of a record with a payload
    are those of the payload read; a revisit's are those its headers give for the whole payload.
    """
    ship(archives.sparkSession)
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = archives.filter("bytes > 0").select(
        "path", F.explode(F.sequence(F.lit(0), (F.col("bytes") - 1).cast("long"), F.lit(split_bytes).cast("long"))).alias("start"))
    names = ["path", "offset", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows, held = [], 0
                for r in records(path, start, start + split_bytes, payloads):
                    whole = r.headers["warc-type"] != "revisit"
                    length = r.payload_bytes if whole else int(r.http.get("content-length", 0))
                    digest = r.payload_digest if whole else r.headers.get("warc-payload-digest", "").rpartition(":")[2]
                    row = [path, r.start, page_of(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), r.headers["warc-type"],
                           page_of(r.headers.get("warc-refers-to")), length, digest]
                    rows.append(row + [r.payload] * payloads)
                    held += r.payload_bytes * payloads + 1000
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "path string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    return ranges.repartition(n, "path", "start").mapInArrow(run, schema)


def archived_pages(pages: DataFrame, **options) -> DataFrame:
    """Write the pages and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_records(write_pages(pages, **options), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
