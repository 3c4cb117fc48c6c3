import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from engramspark.llm import mixing as M


def test_fit_is_near_and_exact():
    for s in range(150):
        r = random.Random(s)
        sizes = r.sample(range(1, 60), r.randint(1, 8))
        have = [r.randint(1, 6) for _ in sizes]
        total = sum(a * b for a, b in zip(sizes, have))
        budget = r.randint(0, total + 5)
        take = M.fit(sizes, have, budget)
        assert all(0 <= t <= h for t, h in zip(take, have))
        got = int(np.dot(take, sizes))
        reach = {0}
        for size, n in zip(sizes, have):
            reach = {x + k * size for x in reach for k in range(n + 1)}
        assert got == max(x for x in reach if x <= budget)


def test_fit_of_many():
    """More words than the table: a proportional part of each length, and still to the word."""
    r = random.Random(9)
    sizes, have = r.sample(range(1, 3000), 300), [r.randint(50, 400) for _ in range(300)]
    total = sum(a * b for a, b in zip(sizes, have))
    for budget in (total // 3, total // 2 + 7, total - 1234):
        take = M.fit(sizes, have, budget)
        assert int(np.dot(take, sizes)) == budget and all(0 <= t <= h for t, h in zip(take, have))
        assert sum(abs(t - h * budget / total) for t, h in zip(take, have)) < 0.1 * sum(have)


def test_fit_long():
    sizes = [500_000, 300_000, 7]
    assert int(np.dot(M.fit(sizes, [3, 3, 10], 1_100_000), sizes)) == 1_100_000
    take = M.fit([10**6], [1000], 10**9 // 2 + 5)
    assert take[0] == 500


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        rest, total = budget - sum(cap * sizes[s] for s in full), sum(w[s] for s in open_)
        t = {s: cap * sizes[s] if s in full else w[s] * rest / total for s in names}
        over = {s for s in open_ if t[s] > cap * sizes[s]}
        if not over:
            return t
        full |= over


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(r.choice([3, 3, 3, r.randint(1, 50)]))), r.choice(["a", "b", "b", "b", "é", "Z", None])) for i in range(600)]
    return spark.createDataFrame(rows + [(900, None, "a"), (901, "", "empty"), (902, "  ", "empty")], "doc_id long, text string, source string").repartition(5)


def check(docs, rows):
    w = re.compile(r"[^\x20\x09-\x0D]+")
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    assert Counter((r.doc_id, r.source) for r in docs.collect()) == Counter((r.doc_id, r.source) for r in rows)
    for r in docs.collect():
        sizes[r.source] += len(w.findall(r.text or ""))
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and (r.taken % r.size == 0 if r.size else not r.taken) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        targets[r.source] = r.target
    want = brute_targets(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 50


def test_mix(many):
    rows = M.mix(many).collect()
    check(many, rows)
    assert sorted(map(str, rows)) == sorted(map(str, M.mix(many.repartition(2)).collect()))  # reruns agree


@pytest.mark.parametrize("broadcast_rows", [1_000_000, -1])
def test_repeated(many, broadcast_rows):
    taken = Counter({r.doc_id: r.taken // r.size for r in M.mix(many).collect() if r.taken})
    assert Counter(r.doc_id for r in M.repeated(many, broadcast_rows=broadcast_rows).collect()) == taken


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "k")] * 11 + [(2, "a b c d", "t", "k")] * 40, "doc_id long, text string, source string, size string")
    mixed = M.mix(docs).collect()
    got = M.repeated(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == {1: sum(r.taken for r in mixed if r.doc_id == 1) // 3, 2: sum(r.taken for r in mixed if r.doc_id == 2) // 4}


def test_odd(odd, none):
    rows = M.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert M.repeated(odd).columns == odd.columns
    assert M.mix(none).collect() == [] and M.repeated(none).collect() == []
