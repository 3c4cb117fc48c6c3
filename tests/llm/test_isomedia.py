import hashlib
import os
import struct
import zlib

import pytest

from engramspark.llm import isomedia as I


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000, 192 * 64, 192 * 64 * 3 + 1])
def test_round_trip(n):
    p = I.padded(os.urandom(n))
    assert len(p) % 192 == 0 and p
    d = I.wrap(p)
    m = I.probe(d)
    assert I.payload_of(d, m) == p and m.codec == "raw " and m.duration == len(p) and m.timescale == 8000
    assert [i for i in m.keyframes] == list(range(0, m.n_samples, 8))
    for a, k in m.keyframe_ranges:
        at = p.index(d[a : a + k])
        assert k == 192 and at % 192 == 0


def test_other_tables():
    """Sample sizes that differ, 64-bit offsets and no list of keyframes."""
    d = I.wrap(I.padded(b"x" * 1000))
    s = d.index(b"stsz") + 8
    n = struct.unpack_from(">I", d, s + 4)[0]
    own = d[: s - 12] + struct.pack(">I4sIII", 20 + 4 * n, b"stsz", 0, 0, n) + struct.pack(f">{n}I", *[192] * n) + d[s + 8 :]
    grown = {k: struct.unpack_from(">I", own, own.index(k) - 4)[0] + 4 * n for k in (b"moov", b"trak", b"mdia", b"minf", b"stbl")}
    for k, v in grown.items():
        i = own.index(k) - 4
        own = own[:i] + struct.pack(">I", v) + own[i + 4 :]
    own = own.replace(b"stss", b"free")
    (c,) = struct.unpack_from(">I", own, own.index(b"stco") + 8)
    moved = own.index(b"mdat") + 4 - struct.unpack_from(">I", own, own.index(b"stco") + 12)[0]
    chunks = [x + moved for x in struct.unpack_from(f">{c}I", own, own.index(b"stco") + 12)]
    i = own.index(b"stco") + 12
    own = own[:i] + struct.pack(f">{c}I", *chunks) + own[i + 4 * c :]
    m = I.probe(own)
    assert m.n_samples == n and len(m.keyframes) == n and {k for _, k in m.sample_ranges} == {192}


def test_bad_bytes():
    d = I.wrap(I.padded(b"abc"))
    for bad in (b"", b"abc", d[:60], os.urandom(500), d.replace(b"stsz", b"free")):
        assert I.probe(bad) is None


def test_table(odd, none):
    texts = [(r.text or "").encode() for r in odd.collect()]
    rows = I.round_trip(odd).collect()
    want = sorted((len(x), hashlib.sha256(I.padded(x)).hexdigest(), zlib.crc32(I.padded(x)[-16:])) for x in texts)
    assert sorted((r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    facts = I.media_facts(I.media_column(odd)).collect()
    assert len(facts) == len(texts) and all(r.duration == len(I.padded(b"x" * r.n_bytes)) for r in facts)
    assert I.round_trip(none).collect() == []


def test_equal_texts_equal_values(spark):
    rows = I.round_trip(spark.createDataFrame([(1, "same"), (2, "same"), (3, "other")], "doc_id long, text string")).collect()
    by = {r.doc_id: tuple(r)[1:] for r in rows}
    assert by[1] == by[2] != by[3]


def track(number, codec, sizes, chunks, per, stts, stss=None, wide=False, scale=1000):
    """A trak box with tables as given."""
    n = len(sizes)
    stbl = [I._full(b"stsd", struct.pack(">I", 1), I._box(codec, bytes(8))), I._full(b"stts", struct.pack(f">{1 + 2 * len(stts)}I", len(stts), *sum(stts, ())))]
    stbl += [I._full(b"stsc", struct.pack(f">{1 + 3 * len(per)}I", len(per), *sum(((a, k, 1) for a, k in per), ()))), I._full(b"stsz", struct.pack(f">{2 + n}I", 0, n, *sizes))]
    stbl.append(I._full(b"co64" if wide else b"stco", struct.pack(f">I{len(chunks)}{'Q' if wide else 'I'}", len(chunks), *chunks)))
    if stss is not None:
        stbl.append(I._full(b"stss", struct.pack(f">{1 + len(stss)}I", len(stss), *stss)))
    mdhd = I._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, scale, sum(k * d for k, d in stts), 0, 0))
    tkhd = I._full(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, 0), bytes(60))
    return I._box(b"trak", tkhd, I._box(b"mdia", mdhd, I._box(b"minf", I._box(b"stbl", *stbl))))


def test_two_tracks():
    """Each track's keyframes are those of its own samples; 64-bit offsets, sizes and durations that differ."""
    sound = lambda base: track(1, b"mp4a", [5, 7], [base], [(1, 2)], [(2, 1024)], scale=48000)
    sight = lambda base: track(2, b"avc1", [12, 3, 4, 10], [base + 12, base + 27], [(1, 2)], [(1, 40), (3, 50)], [1, 4], wide=True)
    head = I._box(b"ftyp", b"isom", bytes(4))
    size = len(head + I._box(b"moov", sound(0), sight(0))) + 8
    data = head + I._box(b"moov", sound(size), sight(size)) + I._box(b"mdat", bytes(range(41)))
    a, v = I.tracks(data)
    assert (a.codec, a.timescale, a.duration, a.keyframes, a.sample_ranges) == ("mp4a", 48000, 2048, [0, 1], [(size, 5), (size + 5, 7)])
    assert (v.track, v.codec, v.timescale, v.duration, v.keyframes) == (2, "avc1", 1000, 190, [0, 3])
    assert v.keyframe_ranges == [(size + 12, 12), (size + 31, 10)] and v.keyframe_times == [0, 140]
    assert I.payload_of(data, v) == bytes(range(12, 41)) and I.probe(data) == a
    assert I.tracks(data[:-5]) == [a]  # of a file that is cut off, the tracks that are whole


def test_fragments():
    """Samples of movie fragments: defaults, own sizes, flags of the first sample, data offsets and runs that follow each other."""
    empty = track(7, b"hvc1", [], [], [], [], [])
    trex = I._full(b"trex", struct.pack(">5I", 7, 1, 20, 6, 0x10000))
    head = I._box(b"ftyp", b"iso5", bytes(4)) + I._box(b"moov", empty, I._box(b"mvex", trex))

    def moof(offset):
        one = I._full(b"trun", struct.pack(">IiI", 3, offset, 0), flags=1 | 4)
        two = I._full(b"trun", struct.pack(">I6I", 2, 30, 4, 0, 31, 9, 0x10000), flags=0x100 | 0x200 | 0x400)
        return I._box(b"moof", I._full(b"mfhd", bytes(4)), I._box(b"traf", I._full(b"tfhd", struct.pack(">I", 7), flags=0x20000), one, two))

    at = len(moof(0)) + 8
    data = head + moof(at) + I._box(b"mdat", bytes(31)) + moof(at) + I._box(b"mdat", bytes(31))
    (m,) = I.tracks(data)
    first, second = len(head) + at, len(head) + at + 31 + at
    assert m.n_samples == 10 and m.sample_ranges[:5] == [(first, 6), (first + 6, 6), (first + 12, 6), (first + 18, 4), (first + 22, 9)]
    assert m.sample_ranges[5] == (second, 6) and m.keyframes == [0, 3, 5, 8]
    assert m.deltas == [(3, 20), (1, 30), (1, 31), (3, 20), (1, 30), (1, 31)] and m.duration == 242 and m.keyframe_times == [0, 60, 121, 181]
    assert I.tracks(data[:-10]) == []  # a fragment's sample lies outside


def test_absurd_tables():
    """Counts beyond the file are no reason to allocate what they say."""
    d = I.wrap(I.padded(b"x" * 400))
    for kind in (b"stsz", b"stts", b"stsc", b"stco", b"stss"):
        i = d.index(kind) + 8 + (4 if kind == b"stsz" else 0)
        assert I.probe(d[:i] + b"\xff\xff\xff\xf0" + d[i + 4 :]) is None
