"""Set-similarity joins without comparing all pairs.

Two sets of a Jaccard similarity of at least t share a token among the first n - ceil(t n) + 1 of either, in any one order
of the tokens. Taking the rarest first makes those few and their groups small, so pairs meet by an equi-join on token.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..sources.store import written

#: Tokens are ordered by how many sets have one of their class, of which there are 2 ** _CLASSES.
_CLASSES = 22
#: Tokens of a block of sets: two blocks are what a task holds.
_BLOCK = 10_000_000
#: Meetings that a task looks at in one go.
_AT_ONCE = 4_000_000


def similar_pairs(df: DataFrame, ident: str, tokens: str, threshold: float, within: Sequence[str] = ()) -> DataFrame:
    """Pairs (a, b) with a < b of one group whose token sets have at least the similarity, with it as ``similarity``.

    Equal sets are one class, named by its smallest member: pairs are those of the classes' names, and of each name with its
    members. A group of copies so gives one pair a copy and not all pairs, and no link between different sets is lost.
    """
    signed = signed_sets(df, ident, tokens, within)
    classes = signed.groupBy(*within, "__s").agg(F.min("__id").alias("__rep"), F.count("*").alias("__n")).where("__n > 1").select(*within, "__s", "__rep")
    copies = written(signed.select(*within, "__s", "__id").join(classes, [*within, "__s"]).where("__id <> __rep").select(*within, "__rep", "__id"), "copies")
    kept = signed.join(copies.select(*within, "__id", F.lit(True).alias("__copy")), [*within, "__id"], "left_anti")
    found = close_sets(kept, threshold, within)
    return found.unionByName(copies.select(*within, F.col("__rep").alias("a"), F.col("__id").alias("b"), F.lit(1.0).alias("similarity")))


def signed_sets(df: DataFrame, ident: str, tokens: str, within: Sequence[str] = (), *more: str) -> DataFrame:
    """Sets that aren't empty, written: __id, the set's SHA-256 as __s, and its tokens as 64-bit hashes __h; texts are tokenised once."""
    rows = df.select(*within, F.col(ident).alias("__id"), F.sort_array(F.col(tokens)).alias("__t"), *more).where(F.size("__t") > 0)
    return written(rows.select(*within, "__id", F.sha2(F.array_join("__t", "\x01"), 256).alias("__s"), F.transform("__t", lambda x: F.xxhash64(x)).alias("__h"), *more), "sets")


def close_sets(rows: DataFrame, threshold: float, within: Sequence[str] = ()) -> DataFrame:
    """Pairs (a, b, similarity) of sets (__id, __h) of one group that are similar enough.

    Sets of a group are ordered by size and cut into blocks of bounded weight, and each pair of blocks of which sizes fit is
    a task: pairs meet by an equi-join on token in its memory and are compared there, so what is shuffled are blocks, as
    often as others fit, and what leaves a task are pairs that are similar. Candidates are neither shuffled nor written.
    """
    spark, n = rows.sparkSession, F.size("__h")
    rows = rows.select(*within, "__id", "__h")
    frequent = spark.sparkContext.broadcast(_frequencies(rows))
    sizes = written(rows.groupBy(*within, n.alias("__n")).agg((F.count("*") * n).alias("__w")), "sizes")
    most = (sizes.groupBy(*within) if within else sizes.groupBy()).agg(F.sum("__w").alias("w")).agg(F.max("w").alias("w")).first().w or 1
    block = min(max(most // 12, 250_000), _BLOCK)
    before = F.sum("__w").over(Window.partitionBy(*within or [F.lit(0)]).orderBy("__n")) - F.col("__w")
    places = written(sizes.withColumn("__from", before), "places")
    blocks = places.select(*within, "__n", F.explode(F.sequence(F.floor(F.col("__from") / block), F.floor((F.col("__from") + F.col("__w")) / block))).alias("__b"))
    blocks = written(blocks.groupBy(*within, "__b").agg(F.min("__n").alias("lo"), F.max("__n").alias("hi")), "blocks")
    i, j = (blocks.select(*within, F.col("__b").alias(f"__{x}"), F.col("lo").alias(f"lo{x}"), F.col("hi").alias(f"hi{x}")) for x in "ij")
    tasks = (i.join(j, [*within]) if within else i.crossJoin(j)).where("__i <= __j").where(F.col("loj") * threshold <= F.col("hii") + 1e-9)
    tasks = tasks.select(*within, "__i", "__j", F.explode(F.array_distinct(F.array("__i", "__j"))).alias("__b"))
    share = F.pmod(F.xxhash64("__id"), F.lit(65536)) / 65536  # of one size, sets go by hash to the blocks that the size has
    placed = _ordered(rows, frequent).withColumn("__n", n).join(small(places), [*within, "__n"])
    placed = placed.withColumn("__b", F.floor((F.col("__from") + share * F.col("__w")) / block)).drop("__from", "__w", "__n")
    shipped = placed.join(small(written(tasks, "tasks")), [*within, "__b"]).select(*within, "__i", "__j", "__b", "__id", "__h")
    kind = rows.schema["__id"].dataType.simpleString()
    own = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in within]

    def each(key: tuple, t: pa.Table) -> pa.Table:
        x, y, score = _compared(t["__h"].combine_chunks(), t["__b"].to_numpy(), threshold)
        ids = t["__id"].combine_chunks()
        group = [pa.repeat(k, len(x)) for k in key[: len(within)]]
        return pa.table([*group, ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(score)], names=[*within, "x", "y", "similarity"])

    met = shipped.groupBy(*within, "__i", "__j").applyInArrow(each, ", ".join([*own, f"x {kind}", f"y {kind}", "similarity double"]))
    pairs = met.where("x <> y").select(*within, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    return written(pairs.dropDuplicates([*within, "a", "b"]), "similar")


def small(df: DataFrame) -> DataFrame:
    """A table of short rows, to be broadcast if it has few: counted, not guessed."""
    return F.broadcast(df) if df.count() <= 200_000 else df


def _frequencies(rows: DataFrame) -> np.ndarray:
    """How many sets have a token of each class of tokens, 0 for few: a table of one size, whatever the input's."""

    def each(batches):
        total = np.zeros(1 << _CLASSES, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False) & ((1 << _CLASSES) - 1), minlength=1 << _CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["c", "f"])

    by = rows.select("__h").mapInArrow(each, "c int, f long").groupBy("c").agg(F.sum("f").alias("f")).where("f > 8").toPandas()
    out = np.zeros(1 << _CLASSES, np.int64)
    out[by["c"].to_numpy()] = by["f"].to_numpy()
    return out


def _ordered(rows: DataFrame, frequent) -> DataFrame:
    """The sets with their rarest tokens first."""
    at = rows.columns.index("__h")

    def each(batches):
        f = frequent.value
        for b in batches:
            h = b.column(at)
            v, n = h.flatten().to_numpy(zero_copy_only=False), h.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((v, f[v & (len(f) - 1)], np.repeat(np.arange(len(n)), n)))
            ordered = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(v[order]))
            yield pa.RecordBatch.from_arrays([ordered if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return rows.mapInArrow(each, rows.schema)


def _compared(sets: pa.ListArray, block: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x, y and the similarity of pairs of sets, tokens in one order, that are similar enough: of one block, or of the two that ``block`` names, the smaller sets in the first."""
    n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    _, token = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    token = token.astype(np.int32)
    start = np.cumsum(n) - n
    rows = np.lexsort((block, n))  # by size, from here on
    n, start, second = n[rows], start[rows], block[rows] == block.max() if len(block) else np.zeros(0, bool)
    alone = bool(second.all())
    least = t / (1 + t)

    head = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1
    doc, pos = np.repeat(np.arange(len(n)), head), _ranges(head)
    word = token[start[doc] + pos].astype(np.int64)
    into = np.arange(len(doc)) if alone else np.flatnonzero(second[doc])
    key = (word[into] << 32) | doc[into]
    order = np.argsort(key)
    key, into = key[order], into[order]
    of = np.arange(len(doc)) if alone else np.flatnonzero(~second[doc])
    # at the first token shared no more can be shared than what is left of the smaller set, which bounds the larger one's size
    most = np.minimum(n[doc[of]] / t, (n[doc[of]] - pos[of] + 1e-9) / least - n[doc[of]])
    last = np.searchsorted(n, np.floor(most + 1e-9), "right") - 1
    lo = np.searchsorted(key, (word[of] << 32) | (doc[of] if alone else 0), "right" if alone else "left")
    count = np.searchsorted(key, (word[of] << 32) | np.maximum(last, 0), "right") - lo
    count[(last < 0) | (count < 0)] = 0
    of, lo, count = of[count > 0], lo[count > 0], count[count > 0]

    bits, hull = _sketches(token, start, n), []
    upto = np.cumsum(count)
    cuts = np.unique(np.searchsorted(upto, np.arange(0, int(upto[-1]) if len(upto) else 0, _AT_ONCE), "left"))
    for begin, stop in zip(cuts, [*cuts[1:], len(of)], strict=False):
        c = count[begin:stop]
        b = into[np.repeat(lo[begin:stop], c) + _ranges(c)]
        x, y, left = np.repeat(doc[of[begin:stop]], c), doc[b], n[doc[b]] - pos[b]
        ok = left >= least * (n[x] + n[y]) - 1e-9
        code = np.unique(x[ok] * len(n) + y[ok])
        x, y = code // len(n), code % len(n)
        # two sets differ in as many tokens at least as their sketches in bits
        apart = np.zeros(len(x), np.int64)
        for w in bits:
            apart += np.bitwise_count(w[x] ^ w[y])
        both = n[x] + n[y]
        hull.append(code[apart <= both - 2 * np.ceil(least * both - 1e-9)])
    code = np.unique(np.concatenate(hull)) if hull else np.zeros(0, np.int64)

    x, y = code // max(len(n), 1), code % max(len(n), 1)
    shared, mark = np.zeros(len(x), np.int64), np.zeros(int(token.max()) + 1 if len(token) else 0, bool)
    edges = np.flatnonzero(np.diff(x, prepend=-1))
    for begin, stop in zip(edges, [*edges[1:], len(x)], strict=False):
        own = token[start[x[begin]] : start[x[begin]] + n[x[begin]]]
        mark[own] = True
        for k in range(begin, stop, 4096):
            other = y[k : min(k + 4096, stop)]
            c = n[other]
            shared[k : k + len(other)] = np.add.reduceat(mark[token[np.repeat(start[other], c) + _ranges(c)]].astype(np.int32), np.cumsum(c) - c)
        mark[own] = False
    score = shared / (n[x] + n[y] - shared)
    ok = score >= t
    return rows[x[ok]], rows[y[ok]], score[ok]


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after another."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _sketches(token: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Words of 64 bits for each set: whether it has an odd number of the tokens of each class."""
    width = 64
    while len(n) and width < min(1.5 * n.max(), 4096):
        width *= 2
    spread = (token.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & (width - 1)
    out = np.zeros((width // 64, len(n)), np.uint64)
    step = max(1, _AT_ONCE // width)
    for k in range(0, len(n), step):
        c = n[k : k + step]
        at = np.repeat(np.arange(len(c)), c) * width + spread[np.repeat(start[k : k + step], c) + _ranges(c)]
        odd = (np.bincount(at, minlength=len(c) * width) & 1).astype(np.uint8)
        out[:, k : k + step] = np.packbits(odd.reshape(len(c), width), axis=1).view(np.uint64).T
    return list(out)


def best_match(pairs: DataFrame, key: str, other: str, score: str = "similarity") -> DataFrame:
    """For each key the match of the highest score, the smallest among equals."""
    return pairs.groupBy(key).agg(F.max_by(F.struct(other, score), F.struct(F.col(score), -F.col(other))).alias("x")).select(key, f"x.{other}", f"x.{score}")


def nearest(queries: DataFrame, corpus: DataFrame, ident: str, vector: str, k: int, least: float = -1.0, block: int = 8192) -> DataFrame:
    """The ``k`` nearest rows of ``corpus`` to each query, by cosine (0 for zero vectors), ties by id; a query isn't its own neighbour.

    Queries go in blocks of at most ``block``, numbered without one task that holds them. A block is broadcast as a matrix, and
    every task over the corpus makes one matrix product per Arrow batch and keeps the best ``k`` of each query, so what is
    shuffled is k rows per query and task. Vectors that are shorter than the longest query are filled with zeros.
    """
    from .ranking import numbered, top_k

    spark, kind = corpus.sparkSession, corpus.schema[ident].dataType.simpleString()
    q = numbered(queries.select(F.col(ident).alias("query_id"), F.col(vector).alias("__q")), [F.col("query_id")], "__n").withColumn("__b", F.floor((F.col("__n") - 1) / block))
    blocks = q.agg(F.max("__b").alias("b")).first().b
    out = spark.createDataFrame([], f"query_id {kind}, neighbour_id {kind}, score double")
    for i in range(0 if blocks is None else blocks + 1):
        rows = q.where(F.col("__b") == i).select("query_id", "__q").orderBy("query_id").collect()  # at most ``block`` vectors
        shared = spark.sparkContext.broadcast(([r.query_id for r in rows], _unit([r["__q"] for r in rows])))

        def each(frames, shared=shared):
            ids, m = shared.value
            best_score, best_id = np.full((len(ids), 0), -np.inf), np.empty((len(ids), 0), object)
            names = np.array(ids, object)
            for f in frames:
                v = _unit(f["__v"].tolist(), m.shape[1])
                score = m @ v.T
                own = f["neighbour_id"].to_numpy(object)
                score[names[:, None] == own[None, :]] = -np.inf
                score, own = np.hstack([best_score, score]), np.hstack([best_id, np.broadcast_to(own, (len(ids), len(own)))])
                order = _best(score, own, k)
                best_score, best_id = np.take_along_axis(score, order, 1), np.take_along_axis(own, order, 1)
            keep = best_score >= max(least, -2.0)
            yield pd.DataFrame({"query_id": np.repeat(names, keep.sum(axis=1)), "neighbour_id": best_id[keep], "score": best_score[keep]})

        found = corpus.select(F.col(ident).alias("neighbour_id"), F.col(vector).alias("__v")).mapInPandas(each, f"query_id {kind}, neighbour_id {kind}, score double")
        out = out.unionByName(top_k(found, ["query_id"], [F.col("score").desc(), F.col("neighbour_id")], k).drop("rank"))
    return out


def _unit(vectors: list, width: int | None = None) -> np.ndarray:
    """Vectors of length 1 (zero vectors stay), filled or cut to one width."""
    vectors = [[] if v is None else v for v in vectors]
    width = max(map(len, vectors), default=0) if width is None else width
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : min(len(v), width)] = v[:width]
    norm = np.array([np.sqrt(np.square(np.asarray(v, float)).sum()) for v in vectors]).reshape(-1, 1)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _best(score: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` of each row: by score, then by the smaller id."""
    if score.shape[1] > 4 * k + 64:  # all that reach the k-th score come into question
        kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        out = np.empty((len(score), k), int)
        for i in range(len(score)):
            at = np.flatnonzero(score[i] >= kth[i])
            out[i] = at[np.lexsort((own[i, at].astype(own[i, at[0]].__class__), -score[i, at]))[:k]]
        return out
    return np.array([np.lexsort((own[i].astype(own[i, 0].__class__), -score[i]))[:k] for i in range(len(score))]).reshape(len(score), -1)


def mentions(texts: DataFrame, ident: str, words: str, names: DataFrame, name: str) -> DataFrame:
    """(ident, name) where a name's words stand next to each other in a text: n-grams of the text, of the lengths that names have, meet the names by an equi-join."""
    w = F.col(words)

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

    known = written(names.select(name).where(F.col(name) != "").distinct(), "known")
    lengths = sorted(r.n for r in known.select(F.size(F.split(name, " ")).alias("n")).distinct().collect())  # a row per length
    if not lengths:
        return texts.select(ident, F.lit("").alias(name)).where(F.lit(False))
    own = F.flatten(F.array(*(F.when(F.size(w) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in lengths)))
    return texts.select(ident, F.explode(F.array_distinct(own)).alias(name)).join(small(known), name)


def overlap(a: Column, b: Column) -> Column:
    return jaccard(a, b)
