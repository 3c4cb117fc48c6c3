import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramspark.llm import lblm as L

W = re.compile(r"[^\x20\x09-\x0D]+")
QUICK = {"enough": 1, "passes": 1}


def tokens(text):
    return [*W.findall((text or "").translate({i: i + 32 for i in range(65, 91)})), "\n"]


@pytest.mark.parametrize("dictionary", [250_000, 40, 0])
def test_counts_and_base(spark, sf, dictionary):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    c = Counter(w for i, r in rows.items() if not held[i] for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    got = L.score_documents(docs, dictionary, **QUICK).collect()
    assert len(got) == len(rows)
    for r in got:
        t = tokens(rows[r.doc_id].text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)


@pytest.mark.parametrize("dictionary, words", [(250_000, 3000), (250_000, 0), (500, 3000), (0, 10)])
def test_score_is_the_probability(spark, sf, dictionary, words):
    """By hand from the model's parameters, with whole softmaxes, for each token after those before it; and all tokens' probabilities sum to 1."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    counts = L.token_counts(docs.where(L.fold(F.col("doc_id")) != L.HELD).select(L.bytes_of().alias("raw")))
    known = L.vocabulary(counts, dictionary, words)
    m = L.train_nce(L.written(L.tokenised(docs, known), "tokens").where("not held_out"), known, **QUICK)
    c = {bytes(r.token): r.n for r in counts.collect()}
    top = sorted((w for w in sorted(c, key=lambda w: (-c[w], w))[:dictionary] if w != L.END and c[w] >= L.LEAST), key=lambda w: (-c[w], w))[:words]
    number = {w: i for i, w in enumerate(sorted(top, key=lambda w: w[::-1]))} | {L.END: len(top)}
    assert known.own == len(top)
    symbol = lambda w: number.get(w, len(top) + 1 + L.rest_of(w))
    seen, kinds = Counter(), Counter()
    for w, n in c.items():
        seen[symbol(w)] += n
        kinds[symbol(w)] += 1
    assert all(seen[len(top) + 1 + i] == known.rest_n[i] and kinds[len(top) + 1 + i] == known.rest_v[i] for i in range(L.RESTS))
    assert known.weights.sum() == sum(c.values()) + known.size
    got = {r.doc_id: r.score for r in L.score_documents(docs, dictionary, words, **QUICK).collect()}

    def log_p(before):
        q = np.concatenate([m.q[s] for s in before]).astype(float)
        h = np.append(q @ m.c.astype(float), 1)
        soft = lambda s: s - np.log(np.exp(s - s.max()).sum()) - s.max()
        words_, classes = soft_parts(h @ m.r.T.astype(float), soft), soft(h @ m.rc.T.astype(float))
        return (words_ + np.repeat(classes, m.span)[: len(words_)]) / np.log(10)

    def soft_parts(s, soft):
        return np.concatenate([soft(s[i : i + m.span]) for i in range(0, len(s), m.span)])

    for r in docs.where("n_chars < 400" if "n_chars" in docs.columns else F.length("text") < 400).limit(6).collect():
        before, want = [symbol(L.END)] * L.CONTEXT, 0.0
        for w in [*r.text.encode().lower().split(), L.END]:
            p, s = log_p(before), symbol(w)
            assert (10**p).sum() == pytest.approx(1)
            want += p[s]
            if s > len(top):
                want += math.log10((c.get(w, 0) + 1) / (seen[s] + kinds[s] + 1))
            before = [s, *before[:-1]]
        assert got[r.doc_id] == pytest.approx(want, rel=1e-4)


def test_step_follows_the_gradient():
    """What a step changes agrees in sign and proportion with the numeric gradient of the loss of noise-contrastive estimation."""
    rng = np.random.default_rng(3)
    weights = rng.integers(1, 50, 60).astype(float)
    m = L.Model(weights, 2, 4)
    noise = L.Noise(weights, m.span, 8, 4)
    before, w, drawn = rng.integers(0, 60, (2, 16)), rng.integers(0, 60, 16), noise.draw(rng)

    def loss(m):
        h = m.hidden(before).astype(float)
        sig = lambda x: 1 / (1 + np.exp(-x))
        k = w // m.span
        own = np.log(sig((h * m.r[w]).sum(1) - noise.log[w])) + np.log(sig((h * m.rc[k]).sum(1) - noise.class_log[k]))
        other = np.log(1 - sig(h @ m.r[drawn[0]].T - noise.log[drawn[0]])).sum() + np.log(1 - sig(h @ m.rc[drawn[1]].T - noise.class_log[drawn[1]])).sum()
        return -own.sum() - other

    after = L._copy(m)
    L.step(after, before, w, noise, drawn, 0.05)
    for name in ("q", "c", "r", "rc"):
        p, moved = getattr(m, name), getattr(after, name) - getattr(m, name)
        for _ in range(12):
            i = tuple(rng.integers(0, n) for n in p.shape)
            up, down = L._copy(m), L._copy(m)
            getattr(up, name)[i] += 1e-2
            getattr(down, name)[i] -= 1e-2
            g = (loss(up) - loss(down)) / 2e-2
            assert abs(moved[i]) < 1e-6 if abs(g) < 1e-4 else g * moved[i] < 0
    assert loss(after) < loss(m)


def test_better_than_an_interpolated_bigram(spark):
    """On held-out texts, by symbol: Witten-Bell interpolation of the bigram and the unigram of the same symbols."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = L.token_counts(docs.where(L.fold(F.col("doc_id")) != L.HELD).select(L.bytes_of().alias("raw")))
    known = L.vocabulary(counts)
    rows = L.written(L.tokenised(docs, known), "tokens")
    train = rows.where("not held_out")

    def flat(df):
        return next(L.windows((np.frombuffer(r.symbols, np.uint16) for r in df.select("symbols").collect()), known.own, L.CONTEXT, 1 << 62))

    (s, at), (hs, hat) = flat(train), flat(rows.where("held_out"))
    u = known.weights / known.weights.sum()
    pairs, after = Counter(zip(s[at - 1].tolist(), s[at].tolist())), np.bincount(s[at - 1], minlength=known.size)
    kinds = np.bincount([a for a, _ in pairs], minlength=known.size)
    h, w = hs[hat - 1], hs[hat]
    share = after[h] / np.maximum(after[h] + kinds[h], 1)
    bigram = np.log10(share * np.array([pairs.get(x, 0) for x in zip(h.tolist(), w.tolist())]) / np.maximum(after[h], 1) + (1 - share) * u[w]).mean()
    got = L.train_nce(train, known).log10(hs, hat).mean()
    assert got > bigram > np.log10(u[w]).mean()


def test_size_makes_no_jump(spark, sf):
    """A corpus just below ``enough`` tokens is trained on like one of just as many, and a round goes over wider shares, not more often, before it goes over all twice."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = L.token_counts(docs.where(L.fold(F.col("doc_id")) != L.HELD).select(L.bytes_of().alias("raw")))
    known = L.vocabulary(counts)
    train = L.written(L.tokenised(docs, known), "tokens").where("not held_out").coalesce(1)
    one, same, more = (L.train_nce(train, known, enough=x * known.n) for x in (1, 1.001, 1.5))
    for name in ("q", "c", "r", "rc"):
        assert np.array_equal(getattr(one, name), getattr(same, name))
    assert one.aq.sum() < more.aq.sum()


def test_averages():
    """Changes of two tasks are averaged by how often each met a row."""
    weights = np.ones(9)
    m = L.Model(weights, 2, 3)
    old = {k: v.copy() for k, v in vars(m).items() if isinstance(v, np.ndarray)}
    a, b = L._copy(m), L._copy(m)
    a.q += 1
    b.q -= 1
    b.c += 2
    met = [np.array([3.0] * 9), np.array([1.0] * 9)]
    sums = {}
    for x, n in ((a, met[0]), (b, met[1])):
        for i, y in L._changes(old, x, n):
            sums[i] = sums.get(i, 0) + y.ravel().astype(float)
    L._apply(m, sums)
    assert np.allclose(m.q - old["q"], 0.5, atol=1e-3) and np.allclose(m.c - old["c"], 0.5, atol=1e-3)


def test_odd(odd, none):
    rows = L.score_documents(odd, **QUICK).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert L.score_documents(none, **QUICK).collect() == []
    held = odd.where(L.fold(F.col("doc_id")) == L.HELD)
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in L.score_documents(held, **QUICK).collect())


def test_sums_and_shares():
    """Rows of an even number of columns are summed two columns at a time, as others are; scores too large for exp, and a sigmoid of any number."""
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 9, 200)
    for d in (6, 7):
        x = rng.normal(size=(200, d)).astype(np.float32)
        rows, sums = L._sums(keys, x, 9)
        assert rows.tolist() == sorted(set(keys.tolist())) and np.allclose(sums, [x[keys == k].sum(axis=0) for k in rows], atol=1e-5)
    s, own = rng.normal(size=(5, 8)).astype(np.float32), np.arange(5)
    want = s[own, own] - np.log(np.exp(s).sum(axis=1))
    assert np.allclose(L._log_share(s.copy(), own, False), want, atol=1e-5) and np.allclose(L._log_share(s + 500, own, True), want, atol=1e-3)
    with np.errstate(over="raise"):
        assert np.allclose(L._sigmoid(np.array([-1e4, 0, 1e4], np.float32)), [0, 0.5, 1])
