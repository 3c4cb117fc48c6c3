"""Web archives: a converter from the legacy ARC format to WARC, a WARC writer with revisit records, and a reader.

``arc_records`` parses ARC files of version 1 (URL, IP, date, type, length) and version 2 (with result code, checksum,
location, offset and file name) by their header lines and declared lengths; what a record declares may be a whole HTTP
response, status line and headers first. ``to_warc`` synthesises for each record the equivalent WARC headers: an identifier
that is a function of the record, the timestamp, the type (``response`` for HTTP, ``resource`` for what has no HTTP head),
the digest of the block, and that of the payload, which is the HTTP entity. A revisit's block is the HTTP head alone.

``write_archives`` converts pages and writes one compressed archive per task into a folder that all executors share. A
task's attempt writes a file of its own name, and only files that the manifest lists are read; so an attempt that is
lost leaves nothing behind that counts. Pages have no dates: all records carry one. Folders are those that ``pyarrow`` can
write to (local ones, HDFS, and S3, whose ``s3a`` it calls ``s3``).

Edge cases: null html is an empty payload, null urls become ``urn:page:<id>``; of rows that share the largest page_id of a
group of equal payloads all are responses; a null page_id counts as smaller than any other, and a group of null ids alone
are responses; an empty table gives an empty result; columns other than ``page_id``, ``url`` and ``html`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, new_path, slices, small_batches, written

LEAST_REVISIT = 1000
_SPACE = re.compile(r"[\x00-\x20\x7f]+")
_STAMP = "20240101000000"
#: Pages in one ARC file, which passes through memory.
ARC_PAGES = 64


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    content_type: str
    result: str | None
    checksum: str | None
    body: bytes


def arc_file(version: int, name: str, records: list[ArcRecord]) -> bytes:
    """An ARC file: its version block, then the records."""
    if version == 1:
        head = f"1 0 {name}\nURL IP-address Archive-date Content-type Archive-length\n".encode()
        out = [f"filedesc://{name} 0.0.0.0 {_STAMP} text/plain {len(head)}\n".encode(), head]
        line = lambda r: f"{r.url} {r.ip} {r.date} {r.content_type} {len(r.body)}\n"
    else:
        head = f"2 0 {name}\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n".encode()
        out = [f"filedesc://{name} 0.0.0.0 {_STAMP} text/plain 200 - - 0 {name} {len(head)}\n".encode(), head]
        line = lambda r: f"{r.url} {r.ip} {r.date} {r.content_type} {r.result or '-'} {r.checksum or '-'} - 0 {name} {len(r.body)}\n"
    for r in records:
        out += [b"\n", line(r).encode(), r.body]
    return b"".join([*out, b"\n"])


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file of either version; ends before a record that is cut off or whose header line isn't one."""
    at, version = 0, 0
    while at < len(data):
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        end = data.find(b"\n", at)
        if end < 0:
            return
        f = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if len(f) not in (5, 10) or not f[-1].isdigit() or version and len(f) != (5 if version == 1 else 10):
            return
        body = data[end + 1 : end + 1 + int(f[-1])]
        if len(body) < int(f[-1]):
            return
        at = end + 1 + len(body)
        if f[0].startswith("filedesc://"):
            version = 1 if body.startswith(b"1 ") else 2
            continue
        v2 = len(f) == 10
        absent = lambda x: None if x == "-" else x
        yield ArcRecord(f[0], f[1], f[2], f[3], absent(f[4]) if v2 else None, absent(f[5]) if v2 else None, body)


class WarcRecord(NamedTuple):
    headers: dict[str, str]
    body: bytes


def _header(r: WarcRecord) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in r.headers.items()) + f"Content-Length: {len(r.body)}\r\n\r\n").encode()


def warc_bytes(r: WarcRecord) -> bytes:
    return _header(r) + r.body + b"\r\n\r\n"


def record_id(*parts: str) -> str:
    """An identifier that is a function of its parts."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def base32_sha1(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_date(arc: str) -> str:
    """An ARC date of 14 digits (8 in old files) as WARC writes it."""
    d = arc.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


_STATUS = re.compile(rb"HTTP/[0-9.]+ [0-9]{3}(?: [^\r\n]*)?\r?\n")


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """The head of an HTTP response, its blank line included, and the entity; None for what is no response. A head without a blank line has an empty entity."""
    if not _STATUS.match(block):
        return None
    ends = [(i + n, i) for i, n in ((block.find(b"\r\n\r\n"), 4), (block.find(b"\n\n"), 2)) if i >= 0]
    end = min(ends, key=lambda x: x[1])[0] if ends else len(block)
    return block[:end], block[end:]


def to_warc(arc: ArcRecord, key: str, refers_to: str | None = None) -> WarcRecord:
    """The WARC record that is equivalent to an ARC record: a response (a resource where the ARC record has no HTTP head), or a revisit of the record ``refers_to`` names."""
    http = http_parts(arc.body)
    head, payload = http or (b"", arc.body)
    block = arc.body if not refers_to else head
    headers = {
        "WARC-Type": "revisit" if refers_to else "response" if http else "resource",
        "WARC-Record-ID": record_id(key),
        "WARC-Date": warc_date(arc.date),
        "WARC-Target-URI": arc.url,
        "WARC-IP-Address": arc.ip,
        "WARC-Block-Digest": base32_sha1(block),
        "WARC-Payload-Digest": base32_sha1(payload),
        "WARC-Page-Key": key,
        "WARC-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response" if http else arc.content_type,
    }
    if http:
        headers["WARC-Identified-Payload-Type"] = arc.content_type
    if refers_to:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to), "WARC-Refers-To-Page": refers_to}
    return WarcRecord(headers, block)


def warc_records(f: BinaryIO) -> Iterator[WarcRecord]:
    """The records of an archive of one gzip member per record, read as a stream: no more than a record is held at a time."""
    rest = b""
    while True:
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            rest = rest or f.read(1 << 20)
            if not rest:
                if parts:
                    raise EOFError("the archive is cut off")
                return
            parts.append(unzip.decompress(rest))
            rest = unzip.unused_data
        data = b"".join(parts)
        head, _, after = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers.pop("Content-Length"))
        if not lines[0].startswith("WARC/") or len(after) != n + 4:
            raise ValueError("not a WARC record")
        yield WarcRecord(headers, after[:n])


def arrow_uri(uri: str) -> str:
    """A path as Hadoop names it, as ``pyarrow`` does."""
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"


def _fs(uri: str):
    """The file system of a URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(uri))


def responses(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """digest and response: for each payload of at least ``least`` bytes that several rows share, the largest page_id. The payloads aren't shuffled, and equal ones are counted before they are."""
    raw = bytes_of("html")
    by = pages.select("page_id", F.sha1(raw).alias("digest"), F.octet_length(raw).alias("n")).where(F.col("n") >= least)
    groups = by.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("response"))
    return groups.where((F.col("n") > 1) & F.col("response").isNotNull()).select("digest", "response")


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, broadcast_rows: int = 200_000, level: int = 1) -> DataFrame:
    """Write the archives below ``path``; returns the manifest, one row (file, records) per archive.

    Which rows revisit is known beforehand. Up to ``broadcast_rows`` groups of equal payloads are broadcast, so that no
    payload is shuffled; more are joined by digest, where adaptive execution splits a hot digest's rows.
    """
    small_batches(pages.sparkSession)
    groups = written(responses(pages, least), "payloads")
    few = groups.count() <= broadcast_rows
    raw = bytes_of("html")
    rows = pages.select("page_id", "url", raw.alias("payload"), F.when(F.octet_length(raw) >= least, F.sha1(raw)).alias("digest"))
    rows = rows.join(F.broadcast(groups) if few else groups, "digest", "left")
    revisits = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    rows = rows.select(F.col("page_id").cast("string").alias("page"), "url", F.when(revisits, F.col("response").cast("string")).alias("refers"), "payload")
    pages.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).mkdirs(pages.sparkSession._jvm.org.apache.hadoop.fs.Path(path))

    def each(batches):
        task, n, nth = TaskContext.get(), 0, 0
        fs, base = _fs(path)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for b in slices(batches, ARC_PAGES):
                rows = list(zip(*(b.column(i).to_pylist() for i in range(4))))
                nth += 1
                arc = legacy([(page, url, payload) for page, url, _, payload in rows], 1 + nth % 2)
                found = 0
                for record, (page, _, refers, _) in zip(arc_records(arc), rows):
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(pack.compress(warc_bytes(to_warc(record, page if page is not None else "-", refers))) + pack.flush())
                    found += 1
                if found != len(rows):
                    raise ValueError(f"{name}: {found} of {len(rows)} records were read back")
                n += found
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"file": [f"{path}/{name}"], "records": [n]}), preserve_index=False)

    return written(rows.mapInArrow(each, "file string, records long"), "manifest").where("records > 0")


def legacy(pages: list[tuple[str | None, str | None, bytes]], version: int) -> bytes:
    """An ARC file that holds the pages (key, url, payload), each as a server would have sent it."""
    records = []
    for page, url, payload in pages:
        target = _SPACE.sub("%20", url.strip()) if url and url.strip() else f"urn:page:{page}"
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        records.append(ArcRecord(target, "0.0.0.0", _STAMP, "text/html", "200", None, head + payload))
    return arc_file(version, "pages.arc", records)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to and, with ``payloads``, payload (null for revisits) of each record of the archives that the manifest lists. A response's digest is computed from what was read, and must be the one stated."""

    def each(batches):
        for b in batches:
            for file in b.column(0).to_pylist():
                fs, at = _fs(file)
                rows = []
                with fs.open_input_stream(at, compression=None) as f:
                    for r in warc_records(f):
                        rows.append(_row(r, payloads))
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string" + ", payload binary" * payloads
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    files = manifest.select("file").repartition(max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism)), "file")
    return files.mapInArrow(each, schema)


def _row(r: WarcRecord, payloads: bool) -> dict:
    h = r.headers
    revisit, stated, key = h["WARC-Type"] == "revisit", h["WARC-Payload-Digest"], h["WARC-Page-Key"]
    digest = base64.b32decode(stated.removeprefix("sha1:")).hex()
    _, body = http_parts(r.body) or (b"", r.body)
    if h["WARC-Block-Digest"] != base32_sha1(r.body) or not revisit and hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"{h['WARC-Record-ID']}: block or payload doesn't have the digest stated")
    return {
        "page_id": None if key == "-" else key,
        "url": h["WARC-Target-URI"],
        "record_type": h["WARC-Type"],
        "payload_bytes": int(h["WARC-Payload-Length"]) if revisit else len(body),
        "payload_digest": digest,
        "refers_to": h.get("WARC-Refers-To-Page"),
    } | ({"payload": None if revisit else body} if payloads else {})


def archived(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes the pages as archives, reads them back and describes each record: the columns of the ``op5`` contract."""
    manifest = write_archives(pages, new_path(pages.sparkSession, "warc"), least)
    kind = pages.schema["page_id"].dataType.simpleString()
    found = read_archives(manifest, payloads=False)
    return found.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))
