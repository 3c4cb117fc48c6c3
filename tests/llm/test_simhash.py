import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from engramspark.llm import simhash as S

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fp(text):
    w = W.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for t in ("", " \t", "One", "one two", "A b c", "x y z q r s", "É é Straße A B C " * 40, "tie tie tie tie"):
        assert S.fingerprint(t.encode()) == brute_fp(t)


def neighbours(seed, n=400):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(30)]
    out = set()
    for _ in range(n):
        x = r.choice(base)
        for _ in range(r.randint(0, 4)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out | {0, 1, 3, 2**64 - 1, 2**63, 2**64 - 2})


@pytest.mark.parametrize("hot", [8192, 3])
def test_links(spark, hot):
    f = neighbours(5)
    signed = [x - 2**64 if x >= 2**63 else x for x in f]
    got = [(r.a, r.b) for r in S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot).collect()]
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(f)) for j in range(i) if bin(f[i] ^ f[j]).count("1") <= 2}
    assert {tuple(sorted(p)) for p in got} == want and len(got) == len(want)


def test_components(spark):
    r = random.Random(2)
    edges = {tuple(sorted(r.sample(range(120), 2))) for _ in range(70)} | {(1000 + i, 1001 + i) for i in range(40)} | {(2000, 2000 + i) for i in range(1, 50)}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {x.node: x.root for x in S.components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert S.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute(rows):
    f = np.array([brute_fp(r.text) for r in rows], "<u8")
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = []
    for i in range(len(rows)):
        js = np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 2)
        near.append(len(js) - 1)
        for j in js:
            a, b = sorted((find(i), find(int(j))))
            parent[b] = a
    comp = defaultdict(list)
    for i, r in enumerate(rows):
        comp[find(i)].append(r.doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in comp.items()}
    return sorted(str((r.doc_id, f"{int(f[i]):016x}", near[i], least[find(i)])) for i, r in enumerate(rows)), len(comp)


def test_documents(spark, odd, none, sf):
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = docs.collect()
        want, groups = brute(rows)
        assert sorted(str(tuple(r)) for r in S.contract(S.near_duplicates(docs)).collect()) == want
        kept = S.without_copies(docs, share=None)
        assert kept.columns == docs.columns and kept.count() == groups
        fewer = {tuple(r) for r in S.without_copies(docs).collect()}
        assert fewer <= {tuple(r) for r in kept.collect()}
    assert S.near_duplicates(none).collect() == [] and S.without_copies(none).collect() == []


def test_both_ways_of_removal(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (sorted(r.doc_id for r in S.without_copies(docs, broadcast_rows=n).collect()) for n in (10**6, -1))
    assert one == two


def brute_segments(text):
    w = [x.strip(".,;:!?\"'()") for x in W.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))]
    out, at = set(), 0
    for i, x in enumerate(w):
        if i + 1 - at >= 3 and zlib.crc32(x.encode()) % 6 == 0 or i + 1 == len(w):
            out.add(" ".join(w[at : i + 1]))
            at = i + 1
    return out


def near_pairs(texts):
    """Jaccard similarities over 3-word shingles, above 0, of texts by number."""
    sets = {i: set(zip(w, w[1:], w[2:])) for i, w in ((i, (t or "").lower().split()) for i, t in texts.items())}
    by, met = defaultdict(list), Counter()
    for i in sorted(sets):
        for x in sets[i]:
            by[x].append(i)
    for same in by.values():
        met.update(itertools.combinations(same, 2))
    return {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in met.items()}


def test_segments():
    for t in ("", "a", "one two", "The cat, sat. " * 30, "É é Straße A (B) C " * 40):
        assert len(S.segments(t.encode())) == len(brute_segments(t))


def test_near_copies_go(spark):
    """On sf0.01: of the pairs of texts with 0.55 of their shingles in common, nine in ten at least lose one; texts that resemble no other stay; what goes is linked to what stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in S.without_copies(docs).collect()}
    pairs = near_pairs({i: t for i, t in texts.items() if len((t or "").split()) >= 50})
    near = [p for p, j in pairs.items() if j >= 0.55 and texts[p[0]] != texts[p[1]]]
    assert len(near) > 50
    assert sum(not (a in kept and b in kept) for a, b in near) >= 0.9 * len(near)
    resembles = {x for p, j in pairs.items() if j >= 0.3 for x in p}
    first = {r.doc_id for r in S.without_copies(docs, share=None).collect()}
    assert {i for i in first if i not in resembles} <= kept
    sets = {i: brute_segments(texts[i]) for i in first}
    linked = lambda a, b: len(sets[a] & sets[b]) >= 0.45 * max(len(sets[a]), len(sets[b]))
    assert all(any(linked(i, j) for j in first if j != i) for i in first - kept)


def test_thousands_of_near_copies(spark):
    """Of 3,000 copies of a text, each with about every thirtieth word changed, hardly any stay but the first; 300 texts that share a passage of 60 words stay."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8)))
    base, passage = [word() for _ in range(300)], [word() for _ in range(60)]
    rows = [(i, " ".join(word() if r.random() < 1 / 30 else w for w in base)) for i in range(3000)]
    rows += [(10_000 + i, " ".join([*(word() for _ in range(70)), *passage, *(word() for _ in range(70))])) for i in range(300)]
    kept = sorted(x.doc_id for x in S.without_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept[0] == 0 and kept[-300:] == list(range(10_000, 10_300)) and len(kept) <= 300 + 0.02 * 3000


def test_segment_links(spark):
    """Every pair found has the share in common; pairs of texts that nothing else resembles are all found."""
    r = random.Random(6)
    sets = [[r.randrange(10**6) for _ in range(r.randint(4, 30))] for _ in range(60)]
    sets += [x[:-2] + [r.randrange(10**6) for _ in range(r.randint(0, 30))] for x in sets]
    sets = [sorted(set(x)) for x in sets]
    node = [r.getrandbits(64) - 2**63 for _ in sets]
    got = {(x.a, x.b) for x in S.segment_links(spark.createDataFrame([*zip(node, sets)], "node long, parts array<long>")).collect()}
    share = lambda i, j: len(set(sets[i]) & set(sets[j])) >= 0.45 * max(len(sets[i]), len(sets[j])) and min(len(sets[i]), len(sets[j])) >= 8
    assert got == {tuple(sorted((node[i], node[j]))) for i in range(len(sets)) for j in range(i) if share(i, j)}
    assert S.segment_links(spark.createDataFrame([], "node long, parts array<long>")).collect() == []


def test_later_rounds_hold_few(spark, monkeypatch):
    """After the first round only nodes near those that left are held against others again: of 200 nodes that share 8 of 20 segments with each neighbour and link to none, and three copies of another text, the copy that stays."""
    seen, w = defaultdict(list), S.written
    monkeypatch.setattr(S, "written", lambda df, name, **o: (out := w(df, name, **o), seen[name].append(out.count()))[0])
    sets = [[*(100 * i + j for j in range(8)), *(100 * ((i + 1) % 200) + j for j in range(8)), *(100 * i + j for j in range(50, 54))] for i in range(200)]
    sets += [[*range(10**6, 10**6 + 19), 10**7 + i] for i in range(3)]
    got = {(x.a, x.b) for x in S.segment_links(spark.createDataFrame([*enumerate(sets)], "node long, parts array<long>")).collect()}
    assert got == {(200, 201), (200, 202), (201, 202)}
    assert seen["parts"][1] == 200 * 16 + 3 * 19 and seen["again"] and max(seen["again"]) <= 19
