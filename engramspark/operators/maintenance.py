"""Graph maintenance: merges, duplicate statements, regrading, guarded deprecations within budgets, idempotent writes."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions.privacy import kind_of
from ..functions.text import tokens
from ..schemas import DEFAULT, EVIDENCE_RANK, Config
from ..sources.store import written
from .ranking import numbered
from .similarity import similar_pairs


def duplicate_candidates(rows: DataFrame, ident: str, text: str, threshold: float, within: Sequence[str]) -> DataFrame:
    """Pairs of statements under one entity that say the same: similar word sets, and neither negated nor dated by weekday against the other."""
    pairs = similar_pairs(rows.withColumn("__w", tokens(F.col(text))), ident, "__w", threshold, within)
    kinds = written(rows.select(*within, F.col(ident).alias("__id"), kind_of(F.col(text)).alias("__kind")), "kinds")  # pairs meet these, not texts
    one, two = (kinds.select(*within, F.col("__id").alias(x), F.col("__kind").alias(f"__{x}")) for x in "ab")
    both = pairs.join(one, [*within, "a"]).join(two, [*within, "b"])
    return both.where(F.col("__a") == F.col("__b")).drop("__a", "__b")


def keepers(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds keeper and loser: the one of the higher grade stays (weights: id, edges, and grade for decisions), then the one with more edges, then the smaller id."""
    names = [c for c in ("grade", "edges") if c in weights.columns]
    rank = F.struct(*(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names)).alias("r")
    w = weights.select("id", rank)
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in names))
    both = pairs.join(w.withColumnsRenamed({"id": "a", "r": "ra"}), "a", "left").join(w.withColumnsRenamed({"id": "b", "r": "rb"}), "b", "left")
    first = F.coalesce("ra", zero) >= F.coalesce("rb", zero)
    return both.withColumns({"keeper": F.when(first, F.col("a")).otherwise(F.col("b")), "loser": F.when(first, F.col("b")).otherwise(F.col("a"))}).drop("ra", "rb")


def budgeted(rows: DataFrame, order: Sequence[Column], ratio: float, total: int | None = None) -> DataFrame:
    """The first rows up to the budget, max(1, int(n * ratio)), in a total order; adds ``nth``. Ranges of rows are sorted, no task holds them all."""
    n = rows.count() if total is None else total
    return numbered(rows, order).where(F.col("nth") <= max(1, int(n * ratio)))


def guard(age_days: Column, level: Column, reason: Column, referenced: Column, config: Config = DEFAULT) -> Column:
    """Why a deprecation is refused, or null: too young or of unknown age, evidence too strong, or target of an edge proposed by this run."""
    strong = (level == "official") | ((level == "corroborated") & (F.length(F.coalesce(reason, F.lit(""))) < config.least_reason))
    return (
        F.when(age_days.isNull() | (age_days < config.least_age_days), "min_age")
        .when(F.coalesce(strong, F.lit(False)), "evidence")
        .when(F.coalesce(referenced, F.lit(False)), "reference")
    )


def regraded(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Decisions (id, level) whose evidence (id, strong) lifts their level: never lowered, official ones untouched."""
    by = evidence.groupBy("id").agg(F.bool_or("strong").alias("strong"), F.count("*").alias("n"))
    both = decisions.join(by, "id", "left").withColumn("proposed", E.grade(F.coalesce("strong", F.lit(False)), F.coalesce("n", F.lit(0))))
    rank = lambda c: F.coalesce(E.lookup(EVIDENCE_RANK, F.col(c)), F.lit(-1))
    return both.where((rank("level") < 3) & (rank("proposed") > rank("level"))).select("id", "level", "proposed")


def graded(claims: DataFrame, votes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """claims (id, pinned) by votes (id, source, agrees): a pinned level stays; else enough distinct sources and no conflict corroborate; else null."""
    by = votes.groupBy("id").agg(F.countDistinct(F.when(F.col("agrees") & (F.col("source") != ""), F.col("source"))).alias("sources"), F.count_if(~F.col("agrees")).alias("conflicts"))
    enough = (F.coalesce("sources", F.lit(0)) >= max(1, config.corroboration)) & (F.coalesce("conflicts", F.lit(0)) == 0)
    return claims.join(by, "id", "left").withColumn("grade", F.coalesce("pinned", F.when(enough, F.lit("corroborated"))))


def merge_map(pairs: DataFrame) -> DataFrame:
    """node and root of each node of alias pairs (a, b): roots are the components' smallest nodes.

    Alternating large and small stars: each round hangs neighbours on the smallest node around and is written before the
    next; a round that changes nothing ends it.
    """
    apart = pairs.where("a <> b")
    now, state = written(apart.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "stars")
        r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not r.n or state == (r.n, r.h):
            break
        state = (r.n, r.h)
    alone = pairs.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    return alone.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def repointed(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """``edges`` (source, target, edge_type) with merged nodes replaced by their roots, without self-loops and repeats."""
    m = merges.where("node <> root")
    out = edges.join(m.withColumnsRenamed({"node": "source", "root": "rs"}), "source", "left").join(m.withColumnsRenamed({"node": "target", "root": "rt"}), "target", "left")
    return out.select(F.coalesce("rs", "source").alias("source"), F.coalesce("rt", "target").alias("target"), "edge_type").where("source <> target").distinct()


def orphans(nodes: DataFrame, edges: DataFrame, ident: str, ratio: float = DEFAULT.deprecation_ratio) -> DataFrame:
    """Nodes without an edge, within the budget, the smallest ids first."""
    total = nodes.count()
    return budgeted(nodes.join(edges.select(ident).distinct(), ident, "left_anti"), [F.col(ident)], ratio, total)


def insert_new(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What of ``rows`` isn't in ``table`` yet, one row per key: the first write wins, and writing twice writes once."""
    return rows.dropDuplicates([*keys]).join(table.select(*keys), [*keys], "left_anti")


def slugs_guarded(rows: DataFrame, base: str, ident: str, text: str, least: float = 0.3) -> DataFrame:
    """(ident, slug): rows of one base slug share it if their texts overlap, else get suffixes 2 to 9, then a hash. Greedy within a slug, so one slug's rows are one pandas frame."""
    import hashlib
    import re

    schema = f"{ident} {df_type(rows, ident)}, slug string"

    def assign(g: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[str, set[str]]] = []
        out = []
        for r in g.sort_values(ident).itertuples(index=False):
            own = {w for w in re.findall(r"\w+", str(getattr(r, text) or "").lower()) if len(w) > 2}
            for name, other in taken:
                if own and other and len(own & other) / len(own | other) >= least:
                    out.append(name)
                    break
            else:
                n, slug = len(taken) + 1, getattr(r, base)
                name = slug if n == 1 else f"{slug}-{n}" if n <= 9 else f"{slug}-{hashlib.sha1(str(getattr(r, text)).encode()).hexdigest()[:8]}"
                taken.append((name, own))
                out.append(name)
        return pd.DataFrame({ident: g.sort_values(ident)[ident].to_numpy(), "slug": out})

    return rows.select(base, ident, text).groupBy(base).applyInPandas(assign, schema)


def df_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def collapse(pairs: DataFrame, group: str, budget: int | None = None) -> DataFrame:
    """Greedy collapse of candidate pairs (group, a, b, similarity) within each group, best first: a node that went is no keeper any more; at most ``budget`` go, if one is given.

    What a pair decides stays within its component of pairs, so without a budget each component is a pandas frame of its own;
    a budget is spent over a whole group, whose pairs are then one frame.
    """
    kind, own = df_type(pairs, "a"), df_type(pairs, group)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        gone: set = set()
        out = []
        for r in g.sort_values(["similarity", "a", "b"], ascending=[False, True, True]).itertuples(index=False):
            if budget is not None and len(out) >= budget:
                break
            if r.a not in gone and r.b not in gone:
                gone.add(r.b)
                out.append((r.a, r.b))
        return pd.DataFrame([(g[group].iloc[0], a, b) for a, b in out], columns=[group, "keeper", "loser"])

    rows = pairs.select(group, "a", "b", "similarity")
    schema = f"{group} {own}, keeper {kind}, loser {kind}"
    if budget is not None:
        return rows.groupBy(group).applyInPandas(run, schema)
    rows = written(rows, "collapse")
    named = merge_map(rows).withColumnsRenamed({"node": "a", "root": "__root"})
    return rows.join(named, "a").groupBy(group, "__root").applyInPandas(run, schema)
