"""Contexts for a model: flattened siblings, budgets, blocks of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine
from ..schemas import DEFAULT, Config
from .ranking import top_k


def flattened_revisions(rows: DataFrame, key: str, siblings: str, limit: int) -> DataFrame:
    """The best revisions of each group: a memory's siblings (array of id, score) stand for it where it has any."""
    own = F.array(F.struct(F.col("id"), F.col("score")))
    flat = rows.select(key, F.explode(F.when(F.size(siblings) > 0, F.col(siblings)).otherwise(own)).alias("x")).select(key, "x.id", "x.score")
    return top_k(flat, [key], [F.col("score").desc_nulls_last(), F.col("id")], limit)


def blocks_within(rows: DataFrame, key: str, order: str, block: str, budget: int, gap: int = 2) -> DataFrame:
    """The first blocks of each group whose running length, with ``gap`` between, stays within the budget; the first always stays."""
    w = Window.partitionBy(key).orderBy(order)
    total = F.sum(F.length(block) + gap).over(w.rowsBetween(Window.unboundedPreceding, 0)) - gap
    return rows.withColumns({"__n": F.row_number().over(w), "__t": total}).where((F.col("__n") == 1) | (F.col("__t") <= budget)).drop("__n", "__t")


def joined_blocks(rows: DataFrame, key: str, order: str, block: str, between: str = "\n\n") -> DataFrame:
    """One context per group: its blocks in order."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, block))), lambda x: x[block]), between).alias("context"))


def composed(rows: DataFrame, key: str, part: str, score: str, ident: str, config: Config = DEFAULT, top: int | None = None) -> DataFrame:
    """Regular rows by score, then at most two bridges and two facts; a top of 0 is no limit for any part."""
    top = config.context_top if top is None else top
    nth = F.row_number().over(Window.partitionBy(key, part).orderBy(F.col(score).desc_nulls_last(), ident))
    most = F.when(F.col(part) == "bridge", config.context_bridges).when(F.col(part) == "fact", config.context_facts).otherwise(top)
    ranked = rows.withColumn("nth", nth)
    return ranked if top == 0 else ranked.where(F.col("nth") <= most)


def two_pass(rows: DataFrame, query: Column, vector: str, score: str = "score") -> DataFrame:
    """Scores replaced by the cosine with the query; the order is the caller's."""
    return rows.withColumn(score, cosine(query, F.col(vector)))


def siblings_by_vector(rows: DataFrame, item: str, ident: str, query: Column, vector: str, least: float, limit: int) -> DataFrame:
    """Siblings of each item whose cosine with the query reaches the threshold, best first."""
    scored = rows.withColumn("score", cosine(query, F.col(vector)))
    return top_k(scored.where(F.col("score") >= least), [item], [F.col("score").desc(), F.col(ident)], limit)


def with_primary(kept: DataFrame, primary: DataFrame, item: str, ident: str) -> DataFrame:
    """``kept`` and, of items that keep something but not their primary, the primary."""
    lost = primary.join(kept.select(item).distinct(), item, "left_semi").join(kept.select(item, ident), [item, ident], "left_anti")
    return kept.unionByName(lost, allowMissingColumns=True)


def sibling_counts(rows: DataFrame, siblings: str) -> DataFrame:
    """Sibling prose replaced by how many there are."""
    return rows.withColumn("sibling_count", F.when(F.col(siblings).isNull(), 0).otherwise(F.size(siblings))).drop(siblings)
