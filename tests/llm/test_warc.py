import base64
import hashlib

import pytest

from tests.compare import TABLES  # noqa: F401
from tidemark.llm import warc, workload

PAGES = "page_id long, url string, html string, path string, start long"


def _want(rows, least=0):
    out, most = [], {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= least:
            most[html or ""] = max(most.get(html or "", page), page)
    for page, _, html in rows:
        raw = (html or "").encode()
        first = most.get(html or "") if len(raw) >= least else None
        again = first is not None and (page is None or page < first)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    return [(i, f"u{i}", [None, "", "x", "é" * 3000, "same", "same"][i % 6]) for i in range(60)] + [
        (70, "a\r\nWARC/1.1\r\n", "z\x1f"), (None, "n", "same"), (None, None, "solo"), (-5, "neg", "minus"), (71, "u" * 9000, "\x1f\u008b\x08WARC/1.1\r\n\r\n" * 50),
        (72, "r", "twice"), (72, "r", "twice"), (2**62, "big", "y")]


@pytest.mark.parametrize("split", [7, 100, 1 << 20])
def test_ranges_of_any_size_give_each_record_once(spark, rows, split):
    df = spark.createDataFrame([(*r, "p", 0) for r in rows], PAGES)
    manifest = warc.write_pages(df, archive_bytes=3000)
    assert _got(warc.read_records(manifest, split_bytes=split)) == _want(rows)


def test_payloads_and_least_bytes(spark, rows):
    df = spark.createDataFrame([(*r, "p", 0) for r in rows], PAGES)
    found = warc.read_records(warc.write_pages(df, least_bytes=10)).collect()
    kept = {(r.page_id, bytes(r.payload)) for r in found if r.record_type == "response" and r.page_id is not None}
    assert {(70, b"z\x1f"), (0, b""), (4, b"same")} <= kept
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == _want(rows, 10)


def test_pages_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert _got(workload.QUERIES["op8_warc"](spark, sf)) == _want([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_empty_table(spark):
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_headers_of_any_length_come_back(spark):
    rows = [(1, "http://a/" + "x" * (2 << 20), "same", None, None), (2, "http://b", "same", None, None), (3, "http://c/" + "y" * (1 << 20), "other", None, None)]
    got = _got(warc.archived_pages(spark.createDataFrame(rows, PAGES)))
    assert got == _want([r[:3] for r in rows]) and len(got) == 3
