"""Ranking: evidence weights, priors, fusion with a cross-encoder's scores, diversity, siblings, merges and caps."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import text as T
from ..schemas import DEFAULT, Config


def _over(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in a total order; Spark cuts groups to ``k`` before the shuffle's sort (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(_over(keys).orderBy(*order))).where(F.col(rank) <= k)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "nth") -> DataFrame:
    """A row number over the whole table in a total order, without one task that holds it: rows are sorted by range and written, and a partition's rows go on from the counts of those before."""
    from ..sources.store import written

    rows = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__p")).agg(F.count("*").alias("__c"))  # a row per partition
    before = sizes.select("__p", (F.sum("__c").over(Window.partitionBy(F.lit(0)).orderBy("__p")) - F.col("__c")).alias("__b"))
    within = F.col("__at").bitwiseAND((1 << 33) - 1)
    return rows.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + within + 1).drop("__at", "__p", "__b")


def evidence_weighted(df: DataFrame, keys: Sequence[str] = (), level: str = "evidence_level", base: str = "base_score") -> DataFrame:
    """Adds ``score``: the base and the level's delta, in groups that have a graded row; others keep their base. Recomputed from the base, so twice is once."""
    graded = F.bool_or(E.is_level(F.col(level))).over(_over(keys))
    return df.withColumn("score", F.when(graded, F.col(base) + E.delta(F.col(level))).otherwise(F.col(base)))


def with_priors(df: DataFrame, config: Config = DEFAULT, level: str = "evidence_level", base: str = "base_score", age: str = "age_days", gap: str | None = None, trusted: Column | None = None) -> DataFrame:
    """Adds ``score``: the base, the evidence delta and the temporal priors, which together don't pass the larger of their caps."""
    time = E.recency(F.col(age), config.recency_half_life, config.recency_max)
    if gap:
        time = time + E.event_proximity(F.col(gap), F.lit(True) if trusted is None else trusted, config.event_half_life, config.event_max)
    return df.withColumn("score", F.col(base) + E.delta(F.col(level)) + F.least(time, F.lit(max(config.recency_max, config.event_max))))


def minmax(value: Column, keys: Sequence[str]) -> Column:
    """Scaled to 0..1 within the group; a constant group is all zeros."""
    w = _over(keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(F.lit(0.0))


def fused(df: DataFrame, keys: Sequence[str], base: str, other: str, weight: float = DEFAULT.cross_encoder_weight) -> DataFrame:
    """Adds ``fused``: both scores scaled within the group and mixed by weight; without a second score in the group, the base."""
    any_other = F.count(other).over(_over(keys)) > 1
    return df.withColumn("fused", F.when(any_other, (1 - weight) * minmax(F.coalesce(base, F.lit(0.0)), keys) + weight * minmax(F.col(other), keys)).otherwise(F.col(base)))


def at_least(df: DataFrame, score: str, least: float) -> DataFrame:
    """Rows without a score, or with one of at least ``least``; a bound outside 0..1 is no bound."""
    return df.where(F.col(score).isNull() | (F.col(score) >= least)) if 0 <= least <= 1 else df


def diversified(df: DataFrame, key: str, ident: str, score: str, text: str, limit: int, lam: float = DEFAULT.mmr_lambda) -> DataFrame:
    """Maximal marginal relevance in each group: greedy, so one group is one pandas frame; groups are the candidates of one query, of bounded number."""
    tokens = T.rank_tokens(F.col(text))
    rows = df.select(key, ident, F.col(score).alias("__s"), tokens.alias("__t"))
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {ident} {df.schema[ident].dataType.simpleString()}, mmr_rank int"

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["__s", ident], ascending=[False, True], na_position="last")
        sets, scores = [set(t) for t in g["__t"]], g["__s"].tolist()
        lo, hi = g["__s"].min(), g["__s"].max()
        rel = [0.0 if not hi > lo else (s - lo) / (hi - lo) if s == s else 0.0 for s in scores]
        left = [i for i, s in enumerate(scores) if s == s]
        rest = [i for i, s in enumerate(scores) if s != s]
        out: list[int] = []
        near = dict.fromkeys(left, 0.0)
        while left and len(out) < limit:
            best = max(left, key=lambda i: (lam * rel[i] - (1 - lam) * near[i], -i))
            out.append(best)
            left.remove(best)
            for i in left:
                both = len(sets[i] & sets[best])
                near[i] = max(near[i], both / (len(sets[i]) + len(sets[best]) - both) if both else 0.0)
        out = (out + rest)[:limit]
        return pd.DataFrame({key: g[key].iloc[out].to_numpy(), ident: g[ident].iloc[out].to_numpy(), "mmr_rank": range(1, len(out) + 1)})

    return rows.groupBy(key).applyInPandas(pick, schema)


def merged(hits: DataFrame, keys: Sequence[str], ident: str, score: str, order: str) -> DataFrame:
    """One row per key: the highest score over all angles, the earliest angle among equals."""
    best = F.max_by(F.struct(*hits.columns), F.struct(F.coalesce(score, F.lit(0.0)), -F.col(order)))
    return hits.groupBy(*keys, ident).agg(best.alias("x")).select("x.*")


def capped(rows: DataFrame, key: str, kind: str, score: str, ident: str, cap: int, facts: int = DEFAULT.fact_results, siblings: int = DEFAULT.sibling_reserve) -> DataFrame:
    """All base rows, edge rows by score in the room that is left, then facts and siblings on top; only where there are more rows than ``cap``."""
    total = F.count("*").over(_over([key]))
    base = F.sum(F.when(F.col(kind) == "base", 1).otherwise(0)).over(_over([key]))
    nth = F.row_number().over(_over([key, kind]).orderBy(F.col(score).desc_nulls_last(), ident))
    room = F.when(F.col(kind) == "edge", F.greatest(F.lit(cap) - base, F.lit(0))).when(F.col(kind) == "fact", facts).when(F.col(kind) == "sibling", siblings)
    return rows.withColumns({"__n": total, "__k": nth, "__r": room}).where((F.col("__n") <= cap) | (F.col(kind) == "base") | (F.col("__k") <= F.col("__r"))).drop("__n", "__k", "__r")


def strong_or_budget(rows: DataFrame, item: str, ident: str, score: str, age: str, text: str, config: Config = DEFAULT, limit: int = 5) -> DataFrame:
    """Siblings of each item: the strong ones by score, or, where none is strong, the oldest first within a budget of characters."""
    strong = F.coalesce(F.col(score) >= config.sibling_strong, F.lit(False))
    w = _over([item])
    any_strong = F.bool_or(strong).over(w)
    running = F.sum(F.length(text)).over(w.orderBy(F.col(age).desc(), ident).rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumns({"__any": any_strong, "__sum": running}).where(F.when(F.col("__any"), strong).otherwise(F.col("__sum") <= config.sibling_chars))
    order = [F.when(F.col("__any"), -F.col(score)).otherwise(-F.col(age)), F.col(ident)]
    return top_k(kept, [item], order, limit).drop("__any", "__sum")


def latest(df: DataFrame, item: str, number: str, flag: str | None = None) -> DataFrame:
    """The latest revision of each item: the flagged one, else the highest number. Aggregated before it is shuffled."""
    order = F.struct(F.col(flag) if flag else F.lit(True), F.col(number))
    return df.groupBy(item).agg(F.max_by(F.struct(*[c for c in df.columns if c != item]), order).alias("x")).select(item, "x.*")


def as_of_order(df: DataFrame, out: Column, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Adds ``as_of_excluded`` and ``position``: valid rows first, both parts in their order; nothing goes."""
    return df.withColumn("as_of_excluded", out).withColumn("position", F.row_number().over(_over(keys).orderBy("as_of_excluded", *order)))


def candidate_order() -> list[Column]:
    """Order of decisions found for a question: facts of place first, then status, then probability."""
    return [F.col(c).desc_nulls_last() for c in ("line_hit", "anchor_hit", "active", "probability", "both_legs", "commit_match", "decided")]


def merged_candidates(legs: Sequence[DataFrame], ident: str, flags: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Union of legs by key: flags are or-ed, scores are maxima, a column that a leg lacks is null."""
    union = legs[0]
    for leg in legs[1:]:
        union = union.unionByName(leg, allowMissingColumns=True)
    return union.groupBy(ident).agg(*(F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags), *(F.max(s).alias(s) for s in scores))
