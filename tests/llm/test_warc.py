"""Archives give every payload back; the index finds every capture of a URL."""

from __future__ import annotations

import gzip
import hashlib

import pytest

from chronoband.llm.warc import lookup, parse, read_archives, record, reversed_host_key, write_archives

BIG = "<p>" + "same words " * 20 + "</p>"


@pytest.mark.parametrize(("url", "key"), [
    ("http://www.Example.com:80/a?b=c#d", "com,example)/a?b=c"), ("https://m.a.example.org", "org,example,a,m)/"),
    ("http://h:8080/x", "h:8080)/x"), ("not a url", "not a url"), ("http://[bad/x", "http://[bad/x"), ("", ""), (None, "")])
def test_key(url, key):
    assert reversed_host_key(url) == key


def test_record_is_plain_warc():
    member = record(7, "http://a/\r\nb", b"x\r\n\r\ny", hashlib.sha256(b"x\r\n\r\ny").hexdigest(), None)
    raw = gzip.decompress(member)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\nx\r\n\r\ny\r\n\r\n")
    assert b"http://a/ b\r\n" in raw
    assert parse(member)["payload"] == b"x\r\n\r\ny"
    broken = gzip.compress(gzip.decompress(member).replace(b"\r\n\r\nx", b"\r\n\r\nz"))
    with pytest.raises(ValueError):
        parse(broken)


ROWS = [(9, "http://b.example/1", BIG), (4, "http://b.example/1", BIG), (5, "http://a.example/", "short"), (6, "http://a.example/", "short"),
        (1, None, None), (2, "http://c.example/é", "ü" * 100), (4, "http://b.example/1", BIG), (None, "http://n.example/", BIG), (8, "", "")]


def test_round_trip_and_lookup(spark):
    pages = spark.createDataFrame([(i, u, h, "clash", 0) for i, u, h in ROWS] + [(100 + k, f"http://many.example/{k % 37}", f"page {k}", "", 0)
                                  for k in range(300)], "page_id bigint, url string, html string, digest string, first int")
    directory, folder = write_archives(pages, block_lines=5)
    got = read_archives(directory, folder).collect()
    assert len(got) == len(ROWS) + 300
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got if r.page_id is None or r.page_id < 100)
    assert kinds == [(-1, "response", None), (1, "response", None), (2, "response", None), (4, "response", None), (4, "response", None),
                     (5, "response", None), (6, "response", None), (8, "response", None), (9, "revisit", 4)]
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
        else:
            assert r.payload is None and r.payload_bytes == len(BIG)
    assert {bytes(r.payload) for r in got if r.page_id == 2} == {("ü" * 100).encode()}
    urls = spark.createDataFrame([("http://many.example/5",), ("http://b.example/1",), ("http://www.many.example/36",), ("http://no.example",), (None,)], "url string")
    hit = sorted(r.page_id for r in lookup(directory, folder, urls).collect())
    assert hit == sorted([9, 4, 4, *[100 + k for k in range(300) if k % 37 in (5, 36)]])


def test_empty_table(spark):
    directory, folder = write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"))
    assert read_archives(directory, folder).count() == 0
    urls = spark.createDataFrame([("http://a.example",)], "url string")
    assert lookup(directory, folder, urls).count() == 0
