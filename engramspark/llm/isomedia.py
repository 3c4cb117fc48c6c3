"""ISO base media files in a column.

``wrap`` stores bytes losslessly as 8-bit samples of an ISO media file: one audio track of raw 8-bit samples, whose access
units of 192 samples lie in chunks, with every eighth unit marked as a random access point. ``probe`` walks the nested boxes
of any such file, track by track, decodes the sample tables (stts, stsc, stsz, stco or co64, stss) and those of movie
fragments (trex, tfhd, trun), and returns codec, duration and the keyframes' times and byte ranges. It never touches the
payload.

Edge cases: null and empty texts become one unit of spaces; bytes of any length are padded with spaces to a positive
multiple of 192; bytes that are no ISO media file, or are cut off, give null fields (``probe`` returns None, ``tracks`` an
empty list), and a track whose tables contradict each other is left out; repeated rows
give equal rows, an empty table an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, bytes_of, new_path

UNIT, RATE, CHUNK, KEY_EVERY = 192, 8000, 64, 8
_CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"))
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body if len(body) < 2**32 - 16 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    """``raw`` with spaces up to a positive multiple of ``unit``."""
    return raw + b" " * (-len(raw) % unit if raw else unit)


def wrap(payload: bytes, unit: int = UNIT, rate: int = RATE, chunk: int = CHUNK, key_every: int = KEY_EVERY) -> bytes:
    """An ISO media file whose only track holds ``payload`` as raw 8-bit samples; the length is a positive multiple of ``unit``."""
    n, duration = len(payload) // unit, len(payload)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    big = len(payload) + 4096 + 8 * (n // chunk + 1) >= 2**32
    header = 16 if len(payload) + 16 >= 2**32 else 8
    whole, tail = divmod(n, chunk)
    firsts = ([(1, chunk)] if whole else []) + ([(whole + 1, tail)] if tail else [])
    keys = range(1, n + 1, key_every)

    def moov(base: int) -> bytes:
        at = [base + i * chunk * unit for i in range(whole + bool(tail))]
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, rate << 16))),
            _full(b"stts", struct.pack(">III", 1, n, unit)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(firsts)), *(struct.pack(">III", a, k, 1) for a, k in firsts)),
            _full(b"stsz", struct.pack(">II", unit, n)),
            _full(b"co64" if big else b"stco", struct.pack(f">I{len(at)}{'Q' if big else 'I'}", len(at), *at)),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        version = int(duration >= 2**32)
        times = lambda *x: struct.pack(">QQIQ" if version else ">IIII", 0, 0, *x)
        mdia = _box(b"mdia", _full(b"mdhd", times(rate, duration), struct.pack(">HH", 0x55C4, 0), version=version), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"SoundHandler\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ" if version else ">IIIII", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=version, flags=7)
        mvhd = _full(b"mvhd", times(rate, duration), struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), _MATRIX, bytes(24), struct.pack(">I", 2), version=version)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    base = len(ftyp) + len(moov(0)) + header
    return ftyp + moov(base) + _box(b"mdat", payload)


def boxes(data: bytes, start: int = 0, end: int | None = None, path: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
    """Path, and start and end of the content, of every box, containers before what they hold. Ends at the first box that doesn't fit."""
    todo = [(start, len(data) if end is None else end, path)]
    while todo:
        at, stop, inside = todo.pop()
        while at + 8 <= stop:
            size, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1 and at + 16 <= stop:
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            elif size == 0:
                size = stop - at
            if size < head or at + size > stop:
                break
            name = inside + b"/" + kind
            yield name, at + head, at + size
            if kind in _CONTAINERS:
                todo += [(at + size, stop, inside), (at + head, at + size, name)]
                break
            at += size


class Media(NamedTuple):
    """A track: ``deltas`` are runs of (samples, duration of each) in units of the timescale."""

    track: int
    codec: str
    timescale: int
    duration: int
    n_samples: int
    sample_ranges: list[tuple[int, int]]
    deltas: list[tuple[int, int]]
    keyframes: list[int]

    @property
    def keyframe_ranges(self) -> list[tuple[int, int]]:
        return [self.sample_ranges[i] for i in self.keyframes]

    @property
    def keyframe_times(self) -> list[int]:
        """Decoding times of the keyframes."""
        out, time, first = [], 0, 0
        runs = iter([*self.deltas, (self.n_samples + 1, 0)])
        count, delta = next(runs)
        for k in self.keyframes:
            while k >= first + count:
                time, first = time + count * delta, first + count
                count, delta = next(runs)
            out.append(time + (k - first) * delta)
        return out


_NOT_SYNC = 0x10000


def tracks(data: bytes) -> list[Media]:
    """The tracks of an ISO media file in the order of the file; samples of movie fragments follow those of the tables. All samples are keyframes where a track lists none."""
    found: list[dict[bytes, tuple[int, int]]] = []
    defaults: dict[int, tuple[int, int, int]] = {}  # by track: duration, size and flags of fragments' samples
    fragments: dict[int, list[tuple[int, int, int, int]]] = {}  # by track: offset, size, duration, flags of each sample
    moof = end = 0
    traf: dict | None = None
    try:
        for path, a, b in boxes(data):
            kind = path.rpartition(b"/")[2]
            if path == b"/moov/trak":
                found.append({})
            elif path.startswith(b"/moov/trak/") and found:
                found[-1].setdefault(kind, (a, b))
            elif path == b"/moov/mvex/trex":
                track, _, *values = struct.unpack_from(">5I", data, a + 4)
                defaults[track] = tuple(values)
            elif path == b"/moof":
                moof = end = a - (8 if data[a - 4 : a] == b"moof" else 16)
            elif path == b"/moof/traf/tfhd":
                traf = _track_fragment(data, a, moof, end, defaults)
            elif path == b"/moof/traf/trun" and traf is not None:
                samples = _run(data, a, b, traf)
                end = traf["at"]
                fragments.setdefault(traf["track"], []).extend(samples)
    except (struct.error, IndexError):
        return []
    out = []
    for at in found:
        m = _track(data, at, fragments)
        if m is not None:
            out.append(m)
    return out


def _track_fragment(data: bytes, a: int, moof: int, end: int, defaults: dict[int, tuple[int, int, int]]) -> dict:
    flags, track = struct.unpack_from(">II", data, a)
    flags &= 0xFFFFFF
    at, (duration, size, sync) = a + 8, defaults.get(track, (0, 0, 0))
    base = moof if flags & 0x20000 else end
    if flags & 1:
        base = struct.unpack_from(">Q", data, at)[0]
        at += 8
    at += 4 if flags & 2 else 0
    values = [duration, size, sync]
    for i, bit in enumerate((8, 16, 32)):
        if flags & bit:
            values[i] = struct.unpack_from(">I", data, at)[0]
            at += 4
    return {"track": track, "base": base, "at": base, "defaults": values}


def _run(data: bytes, a: int, b: int, traf: dict) -> list[tuple[int, int, int, int]]:
    flags, n = struct.unpack_from(">II", data, a)
    flags &= 0xFFFFFF
    at, first = a + 8, None
    if flags & 1:
        traf["at"] = traf["base"] + struct.unpack_from(">i", data, at)[0]
        at += 4
    if flags & 4:
        first = struct.unpack_from(">I", data, at)[0]
        at += 4
    fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    if at + 4 * len(fields) * n > b or not fields and n > len(data):
        raise struct.error("the run is cut off")
    out = []
    for i in range(n):
        own = dict(zip(fields, struct.unpack_from(f">{len(fields)}I", data, at + 4 * len(fields) * i)))
        duration, size, sync = (own.get(bit, d) for bit, d in zip((0x100, 0x200, 0x400), traf["defaults"]))
        if not i and first is not None and 0x400 not in own:
            sync = first
        if traf["at"] < 0 or traf["at"] + size > len(data):
            raise struct.error("a sample lies outside of the file")
        out.append((traf["at"], size, duration, sync))
        traf["at"] += size
    return out


def _track(data: bytes, at: dict[bytes, tuple[int, int]], fragments: dict[int, list[tuple[int, int, int, int]]]) -> Media | None:
    def u32(kind: bytes, skip: int, n: int) -> tuple[int, ...]:
        a, b = at[kind]
        if a + 4 + skip + 4 * n > b:
            raise struct.error("a table is cut off")
        return struct.unpack_from(f">{n}I", data, a + 4 + skip)

    try:
        a = at[b"tkhd"][0]
        track = struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
        a = at[b"mdhd"][0]
        scale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
        codec = data[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16].decode("latin-1")
        same, n = u32(b"stsz", 0, 2)
        if same and same * n > len(data):
            return None
        sizes = (same,) * n if same else u32(b"stsz", 8, n)
        if b"co64" in at:
            (k,) = u32(b"co64", 0, 1)
            wide = u32(b"co64", 4, 2 * k)
            chunks = tuple(x << 32 | y for x, y in zip(wide[::2], wide[1::2]))
        else:
            (k,) = u32(b"stco", 0, 1)
            chunks = u32(b"stco", 4, k)
        (m,) = u32(b"stsc", 0, 1)
        flat = u32(b"stsc", 4, 3 * m)
        (m,) = u32(b"stts", 0, 1)
        times = u32(b"stts", 4, 2 * m)
        if b"stss" in at:
            (m,) = u32(b"stss", 0, 1)
            keys = [x - 1 for x in u32(b"stss", 4, m)]
        else:
            keys = list(range(n))
    except (KeyError, struct.error, IndexError):
        return None
    deltas = list(zip(times[::2], times[1::2]))
    firsts, per = flat[0::3], flat[1::3]
    ranges: list[tuple[int, int]] = []
    for i, first in enumerate(firsts):
        until = firsts[i + 1] - 1 if i + 1 < len(firsts) else len(chunks)
        if not 1 <= first <= until <= len(chunks):
            return None
        for c in range(first - 1, until):
            where = chunks[c]
            for size in sizes[len(ranges) : len(ranges) + per[i]]:
                ranges.append((where, size))
                where += size
    if len(ranges) != n or any(not 0 <= k < n for k in keys) or sum(k for k, _ in deltas) != n or any(a + size > len(data) for a, size in ranges):
        return None
    for where, size, delta, flags in fragments.get(track, ()):
        if not flags & _NOT_SYNC:
            keys.append(len(ranges))
        ranges.append((where, size))
        if deltas and deltas[-1][1] == delta:
            deltas[-1] = (deltas[-1][0] + 1, delta)
        else:
            deltas.append((1, delta))
    if track in fragments:  # the tables' duration is that of the tables' samples
        duration = sum(k * d for k, d in deltas)
    return Media(track, codec, scale, duration, len(ranges), ranges, deltas, keys)


def probe(data: bytes) -> Media | None:
    """The first track of an ISO media file, or None."""
    return next(iter(tracks(data)), None)


def payload_of(data: bytes, media: Media) -> bytes:
    """The samples in order; neighbouring ranges are read at once."""
    merged: list[list[int]] = []
    for a, n in media.sample_ranges:
        if merged and merged[-1][1] == a:
            merged[-1][1] += n
        else:
            merged.append([a, a + n])
    return data[merged[0][0] : merged[0][1]] if len(merged) == 1 else b"".join(data[a:b] for a, b in merged)


def feature(media: Media) -> str:
    """codec;timescale;duration;samples;offset+length of every keyframe."""
    return f"{media.codec};{media.timescale};{media.duration};{media.n_samples};{','.join(f'{a}+{n}' for a, n in media.keyframe_ranges)}"


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the file) of each document. No shuffle."""

    def each(b):
        raws = b.column(1).to_pylist()
        return {"doc_id": b.column(0), "n_bytes": [len(x) for x in raws], "media": [wrap(padded(x)) for x in raws]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", bytes_of().alias("raw")), each, f"doc_id {kind}, n_bytes long, media binary")


def store_media(docs: DataFrame, path: str) -> None:
    """Write the media table: Parquet, zstd, no dictionary."""
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false", "parquet.block.size": str(32 << 20)}
    media_column(docs).write.options(**options).parquet(path)


def media_facts(media: DataFrame) -> DataFrame:
    """codec, timescale, duration and keyframes (time and byte range) of the first track, and the same of ``tracks``, beside doc_id and n_bytes. No payload is decoded."""

    def facts(m: Media) -> dict:
        keys = [{"time": t, "offset": a, "length": n} for t, (a, n) in zip(m.keyframe_times, m.keyframe_ranges)]
        return {"track": m.track, "codec": m.codec, "timescale": m.timescale, "duration": m.duration, "keyframes": keys}

    def each(b):
        found = [[facts(m) for m in tracks(x or b"")] for x in b.column("media").to_pylist()]
        get = lambda c: [f[0][c] if f else None for f in found]
        return {c: b.column(c) for c in ("doc_id", "n_bytes")} | {c: get(c) for c in ("codec", "timescale", "duration", "keyframes")} | {"tracks": found}

    kind = media.schema["doc_id"].dataType.simpleString()
    keys = "keyframes array<struct<time long, offset long, length long>>"
    one = f"codec string, timescale long, duration long, {keys}"
    return by_batch(media.select("doc_id", "n_bytes", "media"), each, f"doc_id {kind}, n_bytes long, {one}, tracks array<struct<track long, {one}>>")


def read_media(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores every document, reads the files back and digests them: the columns of the ``op4`` contract."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "media")
    store_media(docs, path)

    def each(b):
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for data in b.column(2).to_pylist():
            m = probe(data)
            payload = payload_of(data, m)
            for k, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(m))):
                out[k].append(v)
        return {"doc_id": b.column(0), "n_bytes": b.column(1), **out}

    kind = docs.schema["doc_id"].dataType.simpleString()
    stored = read_media(spark, path).select("doc_id", "n_bytes", F.col("media"))
    return by_batch(stored, each, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
