import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from engramspark.llm import packing as P


def brute(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= x]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - x)
        else:
            bins.append(capacity - x)
    return sorted(bins)


def test_best_fit_decreasing():
    for s in range(120):
        r = random.Random(s)
        c = r.choice([5, 10, 37, 64])
        lengths = [r.randint(1, c) for _ in range(r.randint(0, 150))]
        used, cells = Counter(), set()
        for run in P.best_fit_decreasing(Counter(lengths), c):
            for i in range(run.count):
                used[run.bin + i] += run.length
                new = {(run.bin + i, k) for k in range(run.offset, run.offset + run.length)}
                assert not new & cells
                cells |= new
        assert sorted(c - v for v in used.values()) == brute(lengths, c)


def test_tree():
    t = P.Tree(10)
    assert t.tightest(0) is None
    for there in (3, 7, 10):
        t.mark(there, True)
    assert [t.tightest(i) for i in (0, 3, 4, 7, 8, 10)] == [3, 3, 7, 7, 10, 10]
    t.mark(10, False)
    assert t.tightest(8) is None


def test_pack(odd, none):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in odd.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        at = 0
        while at < len(ids):
            k = (len(ids) - at - 1) % 1024 + 1 if not at else 1024
            want[(r.doc_id, at, k, zlib.crc32(np.array(ids[at : at + k], "<u4").tobytes()))] += 1
            at += k
    rows = P.pack(odd).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(by) == len(brute([r.length for r in rows], 1024))
    assert P.pack(none).collect() == []


def test_sequences(odd):
    packed = P.pack(odd, with_ids=True).cache()
    seqs = {r.sequence_id: r.ids for r in P.sequences(packed).collect()}
    for r in packed.collect():
        assert seqs[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    packed.unpersist()


SPECIAL = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "one  <|endoftext|>  two\n\n<|endoftext|>\n", "<|endoftext|", "<|endoftext |> <|ENDOFTEXT|>", "don't<|endoftext|>'t é漢<|endoftext|>😀", "x " * 1500 + "<|endoftext|>" + " y" * 1500]


def test_added_token(spark):
    """Texts that hold the added token's string have the ids of an unchanged ``Tokenizer``."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert t.encode(SPECIAL[0], add_special_tokens=False).ids == [64, 50256, 65]
    rows = P.pack(spark.createDataFrame([*enumerate(SPECIAL)], "doc_id long, text string"), with_ids=True).collect()
    for i, text in enumerate(SPECIAL):
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == t.encode(text, add_special_tokens=False).ids + [2]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces)


def test_very_long_runs(spark):
    """Runs of a million and more of one character are encoded, as ``Tokenizer`` does it."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a" + " " * 2_000_000 + "b <|endoftext|>", "\n \t" * 400_000, "x" * 1_200_000, " " * P.LONG_SPACE, "\u2003" * 1_000_000 + "z"]
    rows = P.pack(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    for i, text in enumerate(texts):
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in pieces)
