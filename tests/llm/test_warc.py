import base64
import hashlib
import io
import zlib

import pytest

from engramspark.llm import warc as W


@pytest.mark.parametrize("version", [1, 2])
def test_arc(version):
    records = [W.ArcRecord("http://a.example/x", "1.2.3.4", "19990102030405", "text/html", "200", None, b"body\n\nwith lines\n"), W.ArcRecord("http://b.example/", "0.0.0.0", "20010101", "text/plain", "404", "abc", b"")]
    got = list(W.arc_records(W.arc_file(version, "f.arc", records)))
    assert [(r.url, r.date, r.body) for r in got] == [(r.url, r.date, r.body) for r in records]
    assert [r.result for r in got] == ([None, None] if version == 1 else ["200", "404"])
    assert list(W.arc_records(W.arc_file(version, "f.arc", records)[:-8]))[:1] == got[:1]
    assert list(W.arc_records(b"nonsense\n")) == []


def test_warc_stream():
    arc = W.ArcRecord("http://a.example/", "1.1.1.1", "20240102030405", "text/html", "200", None, b"\r\n\r\nx" * 500)
    records = [W.to_warc(arc, "5"), W.to_warc(arc, "4", "5")]
    data = b""
    for r in records:
        c = zlib.compressobj(1, zlib.DEFLATED, 31)
        data += c.compress(W.warc_bytes(r)) + c.flush()
    assert list(W.warc_records(io.BytesIO(data))) == records
    assert [r.headers["WARC-Type"] for r in records] == ["resource", "revisit"] and records[1].body == b""
    assert records[1].headers["WARC-Refers-To"] == records[0].headers["WARC-Record-ID"]
    assert records[0].headers["WARC-Date"] == "2024-01-02T03:04:05Z"
    with pytest.raises(EOFError):
        list(W.warc_records(io.BytesIO(data[:-20])))


@pytest.mark.parametrize("broadcast_rows", [200_000, -1])
def test_pages(odd_pages, no_pages, broadcast_rows):
    path = W.new_path(odd_pages.sparkSession, "warc")
    rows = W.read_archives(W.write_archives(odd_pages, path, broadcast_rows=broadcast_rows)).collect()
    pages = odd_pages.collect()
    assert len(rows) == len(pages)
    digest = lambda x: hashlib.sha1((x or "").encode()).hexdigest()
    largest = {}
    for p in pages:
        if p.page_id is not None:
            largest[digest(p.html)] = max(largest.get(digest(p.html), -1), p.page_id)
    want = []
    for p in pages:
        m = largest.get(digest(p.html))
        revisit = len((p.html or "").encode()) >= 1000 and m is not None and p.page_id != m
        want.append((str(p.page_id), len((p.html or "").encode()), digest(p.html), "revisit" if revisit else "response", str(m) if revisit else None))
    assert sorted(map(str, want)) == sorted(str((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows)
    assert all(r.payload is None if r.record_type == "revisit" else hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in rows)
    assert W.archived(no_pages).collect() == []


def test_contract_types(odd_pages):
    assert [c for c, _ in W.archived(odd_pages).dtypes] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("version", [1, 2])
def test_http_heads(version):
    """An ARC body is the whole HTTP response: the payload is its entity, the block all of it, and a revisit keeps the head."""
    entity = b"<p>x\r\n\r\ny</p>"
    head = b"HTTP/1.0 200 OK\r\nServer: a\r\nContent-Type: text/html\r\n\r\n"
    bare = b"HTTP/1.0 404 Not Found\nServer: b\n\n"
    bodies = [head + entity, bare + b"\r\n\r\ngone", b"HTTP/1.1 204\r\nX: y\r\n", b"no head\r\n\r\nat all", b"", head + entity]
    arcs = [W.ArcRecord(f"http://a.example/{i}", "1.2.3.4", "20010203040506", "text/html", "200", None, b) for i, b in enumerate(bodies)]
    read = list(W.arc_records(W.arc_file(version, "f.arc", arcs)))
    assert [r.body for r in read] == bodies
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    want = [entity, b"\r\n\r\ngone", b"", bodies[3], b"", entity]
    for i, (r, payload) in enumerate(zip(read, want)):
        w = W.to_warc(r, str(i), "0" if i == 5 else None)
        h = w.headers
        assert h["WARC-Payload-Digest"] == sha1(payload) and h["WARC-Payload-Length"] == str(len(payload)) and h["WARC-Block-Digest"] == sha1(w.body)
        assert w.body == (head if i == 5 else bodies[i])
        assert (h["WARC-Type"], h["Content-Type"]) == (("resource", "text/html") if i in (3, 4) else ("revisit" if i == 5 else "response", "application/http; msgtype=response"))
        assert W._row(W.WarcRecord(h, w.body), True)["payload"] == (None if i == 5 else payload)


def test_payloads_that_look_like_heads(spark):
    """Payloads that begin as ARC lines, HTTP heads or blank lines come back as they were."""
    texts = ["HTTP/1.1 200 OK\r\n\r\ninner", "\n\n\n", "\r\n\r\nx", "filedesc://a 0.0.0.0 20240101000000 text/plain 3\nabc", "http://a.example/ 1.1.1.1 20240101000000 text/html 5\nhello\n", "é" * 3000]
    pages = spark.createDataFrame([(i, f"http://u.example/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1)
    rows = W.read_archives(W.write_archives(pages, W.new_path(spark, "warc"))).collect()
    assert {int(r.page_id): r.payload.decode() for r in rows} == dict(enumerate(texts))


def test_many_records_per_file(spark):
    """Several ARC files of many records each, of both versions in turn."""
    pages = spark.range(300).selectExpr("id as page_id", "concat('http://u.example/ ', id) as url", "repeat(cast(id as string), cast(id as int)) as html").coalesce(1)
    assert {int(r.page_id): r.payload.decode() for r in W.read_archives(W.write_archives(pages, W.new_path(spark, "warc"))).collect()} == {i: str(i) * i for i in range(300)}


def test_names_of_stores():
    names = {"s3a://b/x": "s3://b/x", "s3n://b/x": "s3://b/x", "s3://b/x": "s3://b/x", "hdfs://n:1/x": "hdfs://n:1/x", "/x": "file:///x", "file:/x": "file:/x"}
    assert {k: W.arrow_uri(k) for k in names} == names
