"""Mixing sources to target weights: budgets by water filling, and their exact fitting by subset sums.

A source's target is its share of the budget by weight, at most ``cap`` times its size; what is cut off is shared again. As
many whole passes over the source as fit come first. What remains is fitted over the histogram of document lengths: a
proportional number of documents of each length, then bounded-knapsack dynamic programming over a reserve of
the last words, so that the sum comes as near the target as the lengths allow. Which documents of a length are taken again
is decided by a seeded hash; ties go by doc_id.

Edge cases: a null text has size 0 and is taken 0 words; null sources are one source, the last; a null doc_id hashes like
any value; repeated rows are separate documents; sources without words have target 0; an empty table gives an empty
result; other columns are ignored (by ``repeated``, kept).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of words (runs of other than the six ASCII spaces); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fit(lengths: Sequence[int], counts: Sequence[int], budget: int, table: int = 1 << 16) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to nearly ``budget`` (never more).

    Lengths are distinct and positive. All but a reserve of ``table`` words, or four of the longest documents, is shared
    out in proportion, then to the longest that fit; the reserve is filled by a bounded-knapsack table over sums, exact
    within itself. A source of fewer words is solved exactly, and any source with a ``table`` of its budget: the table takes
    five bytes a word. Beyond documents of two million words the reserve holds fewer than four of them.
    """
    sizes, have = np.asarray(lengths, "<i8"), np.asarray(counts, "<i8")
    total = int((sizes * have).sum())
    if budget >= total:
        return have.copy()
    if budget <= 0:
        return np.zeros(len(have), "<i8")
    reserve = max(table, min(4 * int(sizes.max()), 1 << 23))
    # integers throughout: counts times budget may pass 2**63
    take = np.array([int(c) * max(0, budget - reserve) // total for c in have.tolist()], "<i8")
    left = budget - int((sizes * take).sum())
    for i in np.argsort(-sizes, kind="stable").tolist():
        if left <= reserve:
            break
        n = min(int(have[i] - take[i]), (left - reserve // 2) // int(sizes[i]))
        if n > 0:
            take[i] += n
            left -= n * int(sizes[i])
    # what is left is no more than the reserve, or than a document longer than half of it and that half
    open_ = np.flatnonzero((have > take) & (sizes <= left))
    if len(open_) and left > 0:
        take += _knapsack(sizes, have - take, open_, left)
    return take


def _knapsack(sizes: np.ndarray, have: np.ndarray, items: np.ndarray, budget: int) -> np.ndarray:
    """The counts whose sum is the largest of at most ``budget``."""
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by = np.full(budget + 1, -1, "<i4")  # the step that first reached a sum
    steps: list[tuple[int, int]] = []
    for i in items[np.argsort(-sizes[items], kind="stable")].tolist():
        size, n, part = int(sizes[i]), int(min(have[i], budget // sizes[i])), 1
        while n > 0 and not reached[budget]:
            k = min(part, n)
            w = k * size
            new = np.flatnonzero(reached[: budget + 1 - w] & ~reached[w:]) + w
            if len(new):
                by[new] = len(steps)
                steps.append((i, k))
                reached[new] = True
            n, part = n - k, part * 2
        if reached[budget]:
            break
    out, at = np.zeros(len(sizes), "<i8"), int(np.flatnonzero(reached)[-1])
    while at:
        i, k = steps[by[at]]
        out[i] += k
        at -= k * int(sizes[i])
    return out


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size: a row per source) with weight and target, by rounds of sharing.

    Weights repeat over the sources by code point, null last. The numbering is by sorted partitions and their counts, each
    round is an aggregate, and the rounds end when no source passes its cap: no task or driver holds the sources.
    """
    spark = sources.sparkSession
    ranged = written(sources.orderBy(F.col("source").asc_nulls_last()).select("source", "source_size", F.monotonically_increasing_id().alias("at")), "sources")
    part = F.shiftright("at", 33).cast("int")
    sizes = sorted((r.part, r.n) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = dict(zip([p for p, _ in sizes], np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()))
    if not before:
        return ranged.select("source", "source_size", F.lit(0.0).alias("weight"), F.lit(0.0).alias("target"))
    nth = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), part) + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth % len(weights) + 1).cast("int"))
    table = ranged.select("source", "source_size", weight.alias("weight"))
    most = F.col("source_size") * F.lit(float(cap))
    budget = float(share) * (table.agg(F.sum("source_size").alias("s")).first().s or 0)
    level = 0.0  # a source's target is weight * level, or its cap
    while True:
        r = table.agg(F.sum(F.when(F.col("weight") * level >= most, most)).alias("full"), F.sum(F.when(F.col("weight") * level < most, F.col("weight"))).alias("weight")).first()
        if not r.weight:
            break
        higher = max(0.0, budget - (r.full or 0.0)) / r.weight
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return table.withColumn("target", F.least(F.col("weight") * level, most))


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 8) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each document.

    Shuffled are short rows without text. A length of a source that many documents share is split into buckets by the high
    bits of their hash, each numbered by itself; prefix sums over the buckets' counts number the whole.
    """
    chosen, facts = _chosen(docs, weights, share, cap, seed)
    out = chosen.join(facts, F.col("source").eqNullSafe(F.col("g_source")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("again"))).alias("taken"))


def _chosen(docs: DataFrame, weights: Sequence[float], share: float, cap: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, source, size, h and whether each is taken once more), and what holds for their sources."""
    rows = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sizes")
    lengths = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    lengths = written(lengths, "lengths")
    goal = written(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)

    def fitted(g: pd.DataFrame) -> pd.DataFrame:
        size, target, full = int(g.source_size.iloc[0]), float(g.target.iloc[0]), int(g.whole.iloc[0])
        some = g[g["size"] > 0].sort_values("size")
        more = fit(some["size"].to_numpy(), some["n"].to_numpy(), round(target - full * size))
        return pd.DataFrame({"source": some["source"].to_numpy(), "size": some["size"].to_numpy(), "more": more})

    budgets = lengths.join(goal, lengths["source"].eqNullSafe(goal["source"])).select(lengths["source"], "size", "n", "source_size", "target", whole.alias("whole"))
    takes = written(budgets.groupBy("source").applyInPandas(fitted, "source string, size long, more long"), "takes")
    takes = takes.where("more > 0")

    marked = rows.withColumn("h", _hash(seed)).withColumn("bucket", F.shiftright("h", 52))
    own = Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id")
    ranked = marked.withColumn("nth", F.row_number().over(own).cast("long"))
    counts = marked.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    counts = counts.join(takes.withColumnsRenamed({"source": "t_source", "size": "t_size"}), F.col("source").eqNullSafe(F.col("t_source")) & (F.col("size") == F.col("t_size")))
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("n")
    quota = counts.select(F.col("source").alias("q_source"), F.col("size").alias("q_size"), F.col("bucket").alias("q_bucket"), (F.col("more") - before).alias("quota"))
    chosen = ranked.join(quota, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size")) & (F.col("bucket") == F.col("q_bucket")), "left")
    again = (F.col("nth") <= F.coalesce("quota", F.lit(0))).cast("long")
    facts = goal.select(F.col("source").alias("g_source"), "source_size", "target", whole.cast("long").alias("whole"))
    return chosen.select("doc_id", "source", "size", "h", again.alias("again")), facts


def repeated(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it was taken, with all its columns. Rows of no words aren't taken.

    Of a length of a source those are taken again whose hash and doc_id don't pass a bound. Up to ``broadcast_rows`` bounds
    are broadcast, so no text is shuffled; more are joined. Only where rows agree in doc_id, source and size and the bound
    falls among them is each row's share of what they were taken joined to it.
    """
    chosen, facts = _chosen(docs, weights, share, cap, seed)
    chosen, facts = written(chosen, "chosen"), written(facts, "facts")
    place = F.struct("h", "doc_id")
    bounds = written(chosen.where("again = 1").groupBy("source", "size").agg(F.max(place).alias("bound")), "bounds").withColumnsRenamed({"source": "b_source", "size": "b_size"})
    on = lambda df, size: df["source"].cast("string").eqNullSafe(bounds["b_source"]) & (size == bounds["b_size"])
    size, n, h, of = fresh(docs, "mix_size", "mix_n", "mix_hash", "mix_of")
    split = chosen.where("again = 0").join(bounds, on(chosen, chosen["size"])).where(place == F.col("bound")).head(1)
    few = bounds.count() <= broadcast_rows
    left = docs.withColumns({size: word_count(F.col("text")), h: _hash(seed)})
    at = left.join(F.broadcast(bounds) if few else bounds, on(left, left[size]), "left").join(facts, left["source"].cast("string").eqNullSafe(facts["g_source"]))
    if not split:
        again = F.coalesce(F.struct(left[h].alias("h"), left["doc_id"].alias("doc_id")) <= F.col("bound"), F.lit(False)).cast("int")
        out = at.where(left[size] > 0).withColumn(n, F.col("whole").cast("int") + again)
    else:
        times = chosen.groupBy("doc_id", "source", "size").agg(F.sum("again").alias(n), F.count("*").alias(of)).withColumnsRenamed({"doc_id": "m_doc", "source": "m_source", "size": "m_size"})
        out = at.join(times, left["doc_id"].eqNullSafe(times["m_doc"]) & left["source"].cast("string").eqNullSafe(times["m_source"]) & (left[size] == times["m_size"])).where(left[size] > 0)
        nth = F.row_number().over(Window.partitionBy("m_doc", "m_source", "m_size").orderBy("text"))
        out = out.withColumn(n, (F.col("whole") + F.floor(F.col(n) / F.col(of)) + (nth <= F.col(n) % F.col(of)).cast("long")).cast("int"))
    return out.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(*[left[c] for c in docs.columns])
