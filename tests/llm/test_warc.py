from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tallyline.llm import warc as W


def expected(pages, least=0):
    out = []
    for page_id, _, html in pages:
        body = (html or "").encode()
        same = [i for i, _, h in pages if (h or "") == (html or "") and i is not None]
        top = max(same, default=None)
        revisit = len(body) >= least and top is not None and page_id != top
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page_id, len(body), digest, "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


PAGES = [
    (1, "http://a.example/x?y=1#z", "<p>é\r\n\r\nWARC/1.0\r\n</p>"),
    (2, "http://a.example", "same"),
    (3, "https://b.example/p", "same"),
    (4, None, None),
    (5, "odd url\r\nX-Injected: 1", ""),
    (3, "https://b.example/p", "same"),
    (None, "http://c.example/", "same"),
    (6, "http://c.example/long", "q" * 300_000),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*p, "n") for p in PAGES], "page_id long, url string, html string, payload string")
    got = W.round_trip(pages, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=repr) == expected(PAGES, least)
    assert W.round_trip(pages.limit(0)).count() == 0


def record(kind, own, to=(), block=b"", content="application/warc-fields"):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", *[f"WARC-Concurrent-To: {t}" for t in to], f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_transactions(spark, tmp_path):
    http = "application/http; msgtype=response"
    one = [
        record("warcinfo", "<i>"),
        record("response", "<r1>", ["<q1>"], b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\n", http),
        record("request", "<q1>", (), b"GET / HTTP/1.1\r\n\r\n", "application/http; msgtype=request"),
        record("metadata", "<m1>", ["<q1>"], b"via: x\r\npage-id: 7\r\n"),
        record("metadata", "<m2>", ["<r1>"]),
    ]
    two = [record("request", "<q9>"), record("metadata", "<m9>", ["<q9>"]), record("resource", "<r2>", (), b"raw", "text/plain"), record("metadata", "<m2>", ["<r1>"])]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in one))
    (tmp_path / "b.warc").write_bytes(b"".join(two))
    records = W.read_records(spark, str(tmp_path), with_payload=True)
    assert records.count() == 9
    got = {r["capture_id"]: r for r in W.assemble_transactions(records).collect()}
    assert set(got) == {"<r1>", "<r2>", "<q9>", "<i>"}
    first = got["<r1>"]
    assert bytes(first["response"]["payload"]) == b"body\r\n\r\n" and first["response"]["payload_bytes"] == 8
    assert [q["record_id"] for q in first["requests"]] == ["<q1>"] and [m["record_id"] for m in first["metadata"]] == ["<m1>", "<m2>"]
    assert got["<q9>"]["response"] is None and [m["record_id"] for m in got["<q9>"]["metadata"]] == ["<m9>"]
    assert bytes(got["<r2>"]["response"]["payload"]) == b"raw"
    (tmp_path / "c.warc").write_bytes(two[2][:-6])
    with pytest.raises(Exception, match="ends within a record"):
        W.read_records(spark, str(tmp_path / "c.warc")).collect()


def test_base32(spark):
    got = spark.createDataFrame([("",), ("abc",)], "s string").select(W.base32_sha1(F.col("s").cast("binary")).alias("d")).collect()
    assert [r["d"] for r in got] == [base64.b32encode(hashlib.sha1(s).digest()).decode() for s in (b"", b"abc")]
