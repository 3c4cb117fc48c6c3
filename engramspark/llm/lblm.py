"""A log-bilinear language model, trained by noise-contrastive estimation.

Tokens are a text's words (A-Z in lower case) and one end. The symbols of the model are the most frequent words of the
corpus, at most ``words`` of those with ``least`` occurrences or more, the end, and 256 symbols for all other words, by their
last two bytes. The context of a token is the ``context`` symbols before it (ends, before a text). Each position has a matrix
of its own: a context's vector is h = sum of q_i C_i, and the score of a symbol w is h . r_w + b_w.

Training goes over every training document, in rounds. A task starts from the parameters of the round before, takes steps
over minibatches of its own documents, and sends back what it changed; changes of a row are averaged over the tasks by how
often each met that row. For every minibatch noise is drawn, ``noise`` symbols from the smoothed unigram distribution, and
the model learns to tell the corpus from it. A second output of the same kind scores classes of symbols.

Scores are normalised: P(w | h) = P(class | h) P(w | class, h), each a softmax over one batch of matrix products, and a word
without a symbol of its own has its add-one share, by unigram count, of the symbol that it falls under. The classes are
runs of symbols in the order of their reversed spelling, as many as each has members, so a token costs two products with
about the square root of the vocabulary.

What is gathered from the corpus grows with it: the exact count of every token over all training documents, and the
vocabulary up to ``words``. Counts of at most ``dictionary`` frequent words are broadcast, none longer than 256 bytes; all
other tokens find theirs by a join. Noise and minibatches are the same for every corpus. Small corpora are gone over
``enough`` tokens' worth of times, ``passes`` at most and once at least; times are no whole number (a round goes over a wider
share of the documents), so the amount of training follows the size without a jump.

Edge cases: a null or empty text is its end alone; a null doc_id counts as training; without training documents all
counts are 0; repeated rows are documents of their own; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, slices, small_batches, written

END = b"\n"  # no word has white space
FOLDS, HELD = 7, 2
RESTS = 256
WORDS, LEAST, CONTEXT, DIM = 16_384, 3, 2, 31
NOISE, CLASS_NOISE, BATCH = 64, 12, 512
#: Shares of the training documents that the rounds go over: parameters are averaged early while they change fast.
ROUNDS = (8, 16, 40)
#: A task of training has so many tokens at least: changes that are averaged over many small tasks get nowhere.
TASK = 4_000_000
_F4 = np.float32


def rest_of(word: bytes) -> int:
    """Which of the symbols for other words a word falls under: by its last two bytes."""
    return (word[-1] * 31 + word[-2 if len(word) > 1 else -1] * 17) % RESTS


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


class Vocabulary(NamedTuple):
    """What is broadcast: the frequent words' places, and by place their counts and symbols; and the totals."""

    place: dict[bytes, int]
    count: np.ndarray
    symbol: np.ndarray
    own: int  # words with a symbol of their own; then the end, then the rests
    n: int
    v: int
    rest_n: np.ndarray
    rest_v: np.ndarray

    @property
    def size(self) -> int:
        return self.own + 1 + RESTS

    @property
    def weights(self) -> np.ndarray:
        """How often each symbol occurs, and once more."""
        out = np.ones(self.size)
        has = self.symbol <= self.own
        out[self.symbol[has]] += self.count[has]
        out[self.own + 1 :] += self.rest_n
        return out

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The places of words (-1 where the dictionary lacks them) and their symbols."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))
        sym = self.symbol[at] if len(self.symbol) else np.zeros(len(words), np.int32)
        for i in np.flatnonzero(at < 0).tolist():
            sym[i] = self.own + 1 + rest_of(words[i]) if words[i] != END else self.own
        return at, sym


def token_counts(train: DataFrame) -> DataFrame:
    """token (UTF-8) and its count n over all training documents. A task merges its own counts before they are shuffled, a part of the vocabulary at a time."""
    arrow = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], schema=arrow)

    def each(batches):
        seen: Counter = Counter()
        for b in slices(batches):
            for raw in b.column(0).to_pylist():
                seen.update(raw.lower().split())
                seen[END] += 1
                if len(seen) > 200_000:
                    yield out(seen)
                    seen.clear()
        if seen:
            yield out(seen)

    return train.select("raw").mapInArrow(each, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, dictionary: int = 250_000, words: int = WORDS, least: int = LEAST) -> Vocabulary:
    """The frequent part of the table of counts: all words above the least level of counts (16 to a doubling) over which no more than ``dictionary`` are; of the next level, as many as still fit."""
    level = F.floor(F.log2("n") * 16).cast("int")
    last = lambda i: F.conv(F.hex(F.expr(f"substring(token, {i}, 1)")), 16, 10).cast("int")
    by = F.when(F.col("token") != F.lit(END), (last("-1") * 31 + last("if(octet_length(token) > 1, -2, -1)") * 17) % RESTS)
    # at most 16 levels per doubling, by 257
    found = counts.groupBy(level.alias("level"), by.alias("rest")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()
    rest_n, rest_v, levels = np.zeros(RESTS), np.zeros(RESTS), Counter()
    for r in found:
        levels[r.level] += r.v
        if r["rest"] is not None:
            rest_n[r["rest"]] += r.n
            rest_v[r["rest"]] += r.v
    n, v = sum(r.n for r in found), sum(levels.values())
    rows, part = 0, None  # part: the level of which not all fit
    for one in sorted(levels, reverse=True):
        if rows + levels[one] > dictionary:
            part = one
            break
        rows += levels[one]
    short = counts.where(F.octet_length("token") <= 256)
    found = [(bytes(r.token), r.n) for r in (short if part is None else short.where(level > part)).collect()]
    if part is not None:
        found += [(bytes(r.token), r.n) for r in short.where(level == part).orderBy(F.desc("n"), "token").limit(dictionary - rows).collect()]
    if not any(w == END for w, _ in found):  # the end is a symbol whatever the dictionary's size
        found += [(END, r.n) for r in short.where(F.col("token") == F.lit(END)).collect()]
    found.sort(key=lambda x: (-x[1], x[0]))
    top = sorted((w for w, _ in [x for x in found if x[0] != END and x[1] >= least][:words]), key=lambda w: w[::-1])
    number = {w: i for i, w in enumerate(top)} | {END: len(top)}
    symbol = np.array([number[w] if w in number else len(top) + 1 + rest_of(w) for w, _ in found], np.int32)
    count = dict(found)
    for w in top:
        rest_n[rest_of(w)] -= count[w]
        rest_v[rest_of(w)] -= 1
    return Vocabulary({w: i for i, (w, _) in enumerate(found)}, np.array([n for _, n in found], np.int64), symbol, len(top), n, v, rest_n, rest_v)


class Model:
    """The parameters, each with the sums of squares that its steps are scaled by (a row's vector shares one).

    q: vectors of context symbols; c: the positions' matrices, one below the other; r and rc: vectors of symbols and of classes, biases in the last column.
    """

    def __init__(self, weights: np.ndarray, context: int = CONTEXT, dim: int = DIM, seed: int = 10) -> None:
        rng, s = np.random.default_rng(seed), len(weights)
        self.context, self.dim, self.span = context, dim, int(np.ceil(np.sqrt(s)))
        of = np.add.reduceat(weights, np.arange(0, s, self.span))
        self.q = rng.normal(0, 0.1, (s, dim)).astype(_F4)
        self.c = np.concatenate([np.eye(dim, dtype=_F4) / context] * context)
        self.r = np.column_stack([rng.normal(0, 0.02, (s, dim)), np.log(weights / weights.sum())]).astype(_F4)
        self.rc = np.column_stack([rng.normal(0, 0.02, (len(of), dim)), np.log(of / of.sum())]).astype(_F4)
        small = lambda *n: np.full(n, 1e-6, _F4)
        self.aq, self.ac, self.ar, self.arc = small(s, 1), small(*self.c.shape), small(s, 2), small(len(of), 2)

    def hidden(self, before: np.ndarray) -> np.ndarray:
        """Context vectors with a last column of ones; ``before`` is of context by tokens, the nearest symbol first."""
        n = before.shape[1]
        h = np.ones((n, self.dim + 1), _F4)
        h[:, :-1] = self.q.take(before.T.ravel(), 0).reshape(n, -1) @ self.c
        return h

    def log10(self, symbols: np.ndarray, at: np.ndarray, part: int = 1 << 14) -> np.ndarray:
        """Normalised log10 probabilities of the symbols at the positions ``at``, each after those before it."""
        out = np.empty(len(at))
        for i in range(0, len(at), part):
            x = at[i : i + part]
            h, w = self.hidden(symbols[x[None, :] - np.arange(1, self.context + 1)[:, None]]), symbols[x]
            k = w // self.span
            large = _norm(h[:, :-1]) * max(_norm(self.r[:, :-1]), _norm(self.rc[:, :-1])) > 60
            order = _order(k, len(self.rc))
            h, w, k, of = h.take(order, 0), w[order], k[order], np.empty(len(x), _F4)
            for j in range(0, len(x), 1024):
                of[j : j + 1024] = _log_share(h[j : j + 1024] @ self.rc.T, k[j : j + 1024], large)
            ends = np.flatnonzero(np.diff(k, prepend=-1, append=-1))
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                first = int(k[a]) * self.span
                of[a:b] += _log_share(h[a:b] @ self.r[first : first + self.span].T, w[a:b] - first, large)
            out[i + order] = of / np.log(10)
        return out


def _log_share(scores: np.ndarray, own: np.ndarray, large: bool) -> np.ndarray:
    """The logarithm of the softmax of each row at the column ``own``; ``large`` if scores may be too large for exp. Overwrites the scores."""
    if large:
        scores -= scores.max(axis=1)[:, None]
    at = scores[np.arange(len(own)), own]
    return at - np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], _F4))


def _norm(x: np.ndarray) -> float:
    """The greatest length of a row."""
    return float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0)))


def _order(keys: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(keys.astype(np.uint16) if n <= 1 << 16 else keys, kind="stable")  # 16 bits are sorted by radix


def _sums(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sums of their rows of values."""
    order = _order(keys, n)
    k = keys[order]
    starts = np.flatnonzero(np.diff(k, prepend=-1))
    x = values.take(order, 0)
    if x.dtype == _F4 and not x.shape[1] % 2:  # two columns at a time
        return k[starts], np.add.reduceat(x.view(np.complex64), starts, axis=0).view(_F4)
    return k[starts], np.add.reduceat(x, starts, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, 80, out=x)  # exp stays finite
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Noise:
    """Draws symbols and classes; the logarithms are those of how often each is expected among the draws."""

    def __init__(self, weights: np.ndarray, span: int, n: int = NOISE, n_classes: int = CLASS_NOISE, power: float = 0.75) -> None:
        p = weights**power / (weights**power).sum()
        of = np.add.reduceat(weights, np.arange(0, len(weights), span)) / weights.sum()
        self.n, self.n_classes = n, n_classes
        self.sums, self.class_sums = np.cumsum(p)[:-1], np.cumsum(of)[:-1]
        self.log, self.class_log = np.log(n * p).astype(_F4), np.log(n_classes * of).astype(_F4)

    def draw(self, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.sums, rng.random(self.n)), np.searchsorted(self.class_sums, rng.random(self.n_classes))


def step(m: Model, before: np.ndarray, w: np.ndarray, noise: Noise, drawn: tuple[np.ndarray, np.ndarray], rate: float) -> None:
    """One step of noise-contrastive estimation on a minibatch: symbols w and drawn noise after the contexts ``before``."""
    n, d, s = len(w), m.dim, len(m.q)
    flat = before.T.ravel()
    e = m.q.take(flat, 0).reshape(n, -1)
    h = np.ones((n, d + 1), _F4)
    h[:, :-1] = e @ m.c
    k, (nw, nk) = w // m.span, drawn
    rw, rk, rn = m.r.take(w, 0), m.rc.take(k, 0), np.concatenate([m.r[nw], m.rc[nk]])
    gw = _sigmoid(np.einsum("ij,ij->i", h, rw) - noise.log[w]) - 1
    gk = _sigmoid(np.einsum("ij,ij->i", h, rk) - noise.class_log[k]) - 1
    g = h @ rn.T
    g -= np.concatenate([noise.log[nw], noise.class_log[nk]])
    _sigmoid(g)
    rw *= gw[:, None]
    rk *= gk[:, None]
    rw += rk
    rw += g @ rn
    dh, dn = rw[:, :-1], g.T @ h
    for table, sums, keys, own, other, to in ((m.r, m.ar, w, gw, dn[: len(nw)], nw), (m.rc, m.arc, k, gk, dn[len(nw) :], nk)):
        x = np.empty((n + len(to), d + 1), _F4)
        np.multiply(h, own[:, None], out=x[:n])
        x[n:] = other
        rows, x = _sums(np.concatenate([keys, to]), x, len(table))
        a = sums.take(rows, 0)
        a[:, 0] += np.einsum("ij,ij->i", x[:, :-1], x[:, :-1]) / d
        a[:, 1] += x[:, -1] ** 2
        sums[rows] = a
        a = rate / np.sqrt(a)
        x[:, :-1] *= a[:, :1]
        x[:, -1] *= a[:, 1]
        table[rows] = table.take(rows, 0) - x
    even = np.zeros((m.context, d + d % 2, d), _F4)  # for _sums
    even[:, :d] = m.c.reshape(m.context, d, d)
    rows, x = _sums(flat, (dh @ even.reshape(-1, d).T).reshape(-1, d + d % 2), s)
    dc = e.T @ dh
    m.ac += dc * dc
    m.c -= 0.3 * rate * dc / np.sqrt(m.ac)
    a = m.aq.take(rows, 0)
    a += np.einsum("ij,ij->i", x, x)[:, None] / d
    m.aq[rows] = a
    x *= rate / np.sqrt(a)
    m.q[rows] = m.q.take(rows, 0) - x[:, :d]


def windows(texts: Iterator[np.ndarray], end: int, context: int, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The symbols of texts, about ``most`` tokens at a time, each text with ends before it, and the positions of its tokens."""
    pad, parts, at, n = np.full(context, end, np.int32), [], [], 0
    for sym in texts:
        parts += [pad, sym]
        at.append(np.arange(n + context, n + context + len(sym)))
        n += context + len(sym)
        if n >= most:
            yield np.concatenate(parts).astype(np.int32, copy=False), np.concatenate(at)
            parts, at, n = [], [], 0
    if parts:
        yield np.concatenate(parts).astype(np.int32, copy=False), np.concatenate(at)


def learn(m: Model, texts: Iterator[np.ndarray], end: int, noise: Noise, rng: np.random.Generator, rates: tuple[float, float], expected: float, passes: int = 1, batch: int = BATCH) -> np.ndarray:
    """Steps over all texts, some of them at a time and these ``passes`` times; returns how often each symbol was met. The rate falls in proportion to the share of ``expected`` tokens that were seen."""
    met, seen = np.zeros(len(m.q)), 0
    back = np.arange(1, m.context + 1)[:, None]
    for symbols, at in windows(texts, end, m.context):
        met += np.bincount(symbols, minlength=len(met))
        for _ in range(passes):
            x = rng.permutation(at)
            for i in range(0, len(x), batch):
                y = x[i : i + batch]
                rate = rates[0] + (rates[1] - rates[0]) * min(1.0, seen / expected)
                step(m, symbols[y[None, :] - back], symbols[y], noise, noise.draw(rng), rate)
                seen += len(y) / passes
    return met


_CHUNK = 4096


def _changes(old: dict, m: Model, met: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """What a task changed, by chunks of rows: a row's weight, its changes times the weight, and the growth of its sums of squares."""
    w = (met + 1e-3).astype(_F4)[:, None]
    rows = np.hstack([w, w * (m.q - old["q"]), w * (m.r - old["r"]), m.aq - old["aq"], m.ar - old["ar"]]).astype(_F4)
    for i in range(0, len(rows), _CHUNK):
        yield i // _CHUNK, rows[i : i + _CHUNK]
    n = _F4(met.sum())
    shared = [x.ravel() for x in (n * (m.c - old["c"]), n * (m.rc - old["rc"]), m.ac - old["ac"], m.arc - old["arc"])]
    yield -1, np.concatenate([[n], *shared]).astype(_F4)


def _apply(m: Model, chunks: dict[int, np.ndarray]) -> None:
    """The averages of all tasks' changes."""
    d = m.dim
    for i, x in chunks.items():
        if i >= 0:
            x = x.reshape(-1, 2 * d + 5)
            a, b = i * _CHUNK, i * _CHUNK + len(x)
            m.q[a:b] += x[:, 1 : 1 + d] / x[:, :1]
            m.r[a:b] += x[:, 1 + d : 2 + 2 * d] / x[:, :1]
            m.aq[a:b] += x[:, 2 + 2 * d : 3 + 2 * d]
            m.ar[a:b] += x[:, 3 + 2 * d :]
        elif x[0] > 0:
            at = 1
            for name, scale in (("c", x[0]), ("rc", x[0]), ("ac", 1), ("arc", 1)):
                p = getattr(m, name)
                p += x[at : at + p.size].reshape(p.shape) / scale
                at += p.size


def train_nce(train: DataFrame, words: Vocabulary, context: int = CONTEXT, dim: int = DIM, rate: float = 0.1, enough: float = 12e6, passes: int = 12, rounds: tuple[int, ...] = ROUNDS, seed: int = 10) -> Model:
    """The model of all training documents (``symbols`` as ``tokenised`` has them, and ``part``, a hash). Each is read in one of the rounds.

    A round's tasks are as many as the cluster has cores, or a sixteenth of the input's partitions if that is more. Shuffled
    are their changes, each as long as the model; the driver has their sums alone.
    """
    weights = words.weights
    m, total = Model(weights, context, dim, seed), sum(rounds)
    if not words.n:
        return m
    sc = train.sparkSession.sparkContext
    parts = train.rdd.getNumPartitions()
    again = max(1.0, min(passes, enough / words.n))
    tasks = int(max(1, min(parts, max(sc.defaultParallelism, parts // 16), again * words.n // TASK)))
    done, schema = 0, pa.schema([("chunk", pa.int32()), ("data", pa.binary())])
    end = words.own
    for number, share in enumerate(rounds):
        low, high = done, done + share
        rates = tuple(rate * (1.05 - x / total) for x in (low, high))
        # where the texts are gone over again, each round does so with as many of them as there are
        times = max(1, round(again * share / total))
        wide = min(total, max(share, round(again * share / times)))
        first = min(low, total - wide)
        expected = max(1.0, words.n * wide / total / tasks)
        now = sc.broadcast(m)

        def each(batches, now=now, rates=rates, expected=expected, number=number, times=times):
            m = now.value
            old = {k: v.copy() for k, v in vars(m).items() if isinstance(v, np.ndarray)}
            m = _copy(m)
            texts = (x for b in batches for x in _arrays(b.column(0), len(weights)))
            rng = np.random.default_rng((seed, number, TaskContext.get().partitionId()))
            met = learn(m, texts, end, Noise(weights, m.span), rng, rates, expected, times)
            if met.any():
                for i, x in _changes(old, m, met):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], schema=schema)

        def summed(batches):
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for i, raw in zip(b.column(0).to_pylist(), b.column(1)):
                    x = np.frombuffer(raw.as_buffer(), _F4)
                    sums[i] = sums[i] + x if i in sums else x.astype(np.float64)
            for i, x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.astype(_F4).tobytes()], pa.binary())], schema=schema)

        own = train.where(F.pmod(F.col("part"), F.lit(total)).between(first, first + wide - 1)).select("symbols").coalesce(tasks)
        found = own.mapInArrow(each, "chunk int, data binary").repartition("chunk").mapInArrow(summed, "chunk int, data binary").toArrow()
        _apply(m, {i: np.frombuffer(x.as_buffer(), _F4).astype(np.float64) for i, x in zip(found.column(0).to_pylist(), found.column(1))})
        now.unpersist()
        done = high
    return m


def _copy(m: Model) -> Model:
    out = object.__new__(Model)
    for k, v in vars(m).items():
        setattr(out, k, v.copy() if isinstance(v, np.ndarray) else v)
    return out


def _kind(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.int32


def _arrays(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    kind = _kind(size)
    return (np.frombuffer(x.as_buffer(), kind) for x in column)


def tokenised(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """doc_id, held_out, part (a hash), row (a number), n_tokens, found (tokens in the dictionary), base (their logarithms' sum), rest (what words without a symbol of their own add to the model's score, as far as the dictionary has them), rare and times (the other tokens and how often each occurs) and symbols (packed) of each document. No shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, part long, row long, n_tokens long, found long, base double, rest double, rare array<binary>, times array<int>, symbols binary"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def each(batches):
        known = shared.value
        logs, own, packed = np.log10(known.count + 1), known.own, _kind(known.size)
        in_rest = np.log10(known.rest_n + known.rest_v + 1)
        task, nth = TaskContext.get().partitionId() << 33, 0
        for b in slices(batches, 200):
            tokens: list[bytes] = []
            lengths, rare, times = [], [], []
            for raw in b.column(3).to_pylist():
                found = raw.lower().split()
                found.append(END)
                lengths.append(len(found))
                tokens += found
            at, sym = known.symbols(tokens)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            lost = np.flatnonzero(at < 0)
            for a, z in zip(np.searchsorted(lost, starts[:-1]).tolist(), np.searchsorted(lost, starts[1:]).tolist()):
                c = Counter(tokens[i] for i in lost[a:z].tolist())
                rare.append(list(c))
                times.append(list(c.values()))
            del tokens
            base = logs[at] if len(logs) else np.zeros(len(at))
            base[lost] = 0.0
            rest = np.zeros(len(at))
            other = np.flatnonzero(sym > own)
            rest[other] = base[other] - in_rest[sym[other] - own - 1]
            sym = sym.astype(packed)
            sums = lambda x: np.add.reduceat(x, starts[:-1])  # noqa: B023, E731
            cols = [task + nth + np.arange(len(lengths)), lengths, sums((at >= 0).astype(np.int64)), sums(base), sums(rest), rare, times, [sym[a:z].tobytes() for a, z in zip(starts.tolist(), starts[1:].tolist())]]
            nth += len(lengths)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), b.column(1), b.column(2), *(pa.array(x, f.type) for x, f in zip(cols, list(arrow)[3:]))], schema=arrow)

    held = (fold(F.col("doc_id")) == HELD).alias("held_out")
    part = F.xxhash64(F.col("doc_id").cast("string")).alias("part")
    return docs.select("doc_id", held, part, bytes_of().alias("raw")).mapInArrow(each, schema)


def score_documents(docs: DataFrame, dictionary: int = 250_000, words: int = WORDS, least: int = LEAST, **training) -> DataFrame:
    """The columns of the ``op10`` contract. The texts are scanned twice, for counts and for symbols, which are written; training and scores read those. Shuffled are the tasks' counts and changes, and of each text the tokens that the dictionary lacks. ``training`` goes to ``train_nce``."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    train = docs.where(fold(F.col("doc_id")) != HELD).select(bytes_of().alias("raw"))
    counts = written(token_counts(train), "counts")
    known = vocabulary(counts, dictionary, words, least)
    tokens = written(tokenised(docs, known), "tokens")
    model = train_nce(tokens.where("not held_out").select("symbols", "part"), known, **training)
    shared = spark.sparkContext.broadcast(model)
    end, size = known.own, known.size

    def each(batches):
        model = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                found = [*_arrays(part.column(1), size)]
                symbols, at = next(windows(iter(found), end, model.context, 1 << 62))
                sums = np.add.reduceat(model.log10(symbols, at), np.cumsum([0, *map(len, found)])[:-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums)], schema=scored)

    scored = pa.schema([("row", pa.int64()), ("score", pa.float64())])
    model_part = tokens.select("row", "symbols").mapInArrow(each, "row long, score double")
    rare = tokens.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("k"))
    seen = counts.select("token", "n")
    more = rare.join(seen, "token").groupBy("row").agg(F.sum("k").cast("long").alias("k"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("logs"))
    total = float(np.log10(known.n + known.v + 1))
    logs = F.coalesce("logs", F.lit(0.0))
    facts = tokens.select("doc_id", "held_out", "row", "n_tokens", "found", "base", "rest")
    return facts.join(model_part, "row").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("found") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(known.n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("score") + F.col("rest") + logs).alias("score"),
    )
