"""The engine as one object: memory tables in, ranked memories out.

Every method is a plan over DataFrames; nothing is collected. Model calls are functions that the caller gives: a reranker
scores (query, texts), an embedder makes vectors, a summariser tells a conversation, an assessor judges texts; they are
called by Arrow batch, and without them the path is deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .functions import evidence as E
from .functions.privacy import screened
from .functions.text import approx_tokens, one_line
from .operators import context, graph, maintenance, ontology, profiling, ranking, rendering, runs, search, state
from .operators import sessions as sess
from .schemas import DEFAULT, Config

Reranker = Callable[[str, Sequence[str]], Sequence[float]]
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Summariser = Callable[[Sequence[str]], Sequence[str]]
Assessor = Callable[[list[str]], Sequence[str]]


def with_cross_encoder(rows: DataFrame, query: str, text: str, rerank: Reranker) -> DataFrame:
    """Adds ``cross_encoder``: the reranker's scores by Arrow batch, null where it fails or gives another number of them."""

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        try:
            out = list(rerank(query, texts.fillna("").tolist()))
        except Exception:  # a model's failure leaves the order as it was
            out = []
        return pd.Series(out if len(out) == len(texts) else [None] * len(texts), dtype="float64")

    return rows.withColumn("cross_encoder", score(one_line(F.col(text))))


def embedded(rows: DataFrame, text: str, embed: Embedder, into: str = "embedding") -> DataFrame:
    """Adds the vectors of an embedder, by Arrow batch; null where it fails or gives another number of them, and for blank texts."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        blank = texts.fillna("").str.strip() == ""
        try:
            out = [[float(x) for x in v] for v in embed(texts[~blank].tolist())]
        except Exception:  # a model's failure leaves the rows without vectors
            out = []
        found = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        if len(out) == int((~blank).sum()):
            for i, v in zip(texts.index[~blank], out):
                found.at[i] = v
        return found

    return rows.withColumn(into, vectors(one_line(F.col(text))))


def summarised(messages: DataFrame, summarise: Summariser) -> DataFrame:
    """session_id and summary of each session by a summariser, which sees the screened conversation as Markdown; null where it fails."""

    @F.pandas_udf("string")
    def told(texts: pd.Series) -> pd.Series:
        try:
            out = list(summarise(texts.fillna("").tolist()))
        except Exception:  # the caller falls back
            out = []
        return pd.Series(out if len(out) == len(texts) else [None] * len(texts), dtype=object)

    return sess.markdown(messages).select("session_id", told(screened(F.col("markdown"))).alias("summary"))


@dataclass
class Memory:
    """Tables of the memory graph, as in ``schemas.TABLES``; those that a method doesn't need may be absent."""

    spark: SparkSession
    revisions: DataFrame
    edges: DataFrame | None = None
    messages: DataFrame | None = None
    config: Config = DEFAULT
    rerank: Reranker | None = field(default=None)
    embed: Embedder | None = field(default=None)
    summarise: Summariser | None = field(default=None)

    def search(self, queries: DataFrame, limit: int = 10, text: str = "summary") -> DataFrame:
        """The best revisions of each query (query_id, query) by BM25 within project and kind."""
        live = self.revisions.where("NOT deprecated")
        hits = search.bm25(live, queries, "kref", text)
        return ranking.top_k(hits, ["query_id"], [F.col("score").desc(), F.col("id")], limit)

    def recall(self, queries: DataFrame, limit: int = 5, text: str = "summary") -> DataFrame:
        """Wide search, then evidence and recency, then the best of each query; with a reranker its scores are mixed in before."""
        wide = self.search(queries, limit * 4, text).join(self.revisions.withColumnRenamed("kref", "id"), "id").withColumnRenamed("score", "base_score")
        level = E.level_of(F.col("evidence_level"), F.col("tags"))
        aged = wide.withColumns({"evidence_level": level, "age_days": F.datediff(F.current_date(), F.to_date("created_at"))})
        return ranking.top_k(ranking.with_priors(aged, self.config), ["query_id"], [F.col("score").desc(), F.col("id")], limit)

    def engage(self, queries: DataFrame, limit: int = 5, least: float = 0.0, full: bool = False, text: str = "summary") -> DataFrame:
        """What a host asks before it answers: query_id, context, krefs, results and approximate tokens of the memories that reach the least score."""
        rows = ranking.at_least(self.recall(queries, limit, text), "score", least)
        facts = F.element_at("metadata", "facts")
        rows = rows.withColumn("facts", facts)
        told = rendering.recalled_context(rows, "query_id", "rank", full, config=self.config)
        krefs = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x.id).alias("krefs"))
        out = queries.select("query_id").distinct().join(told, "query_id", "left").join(krefs, "query_id", "left")
        context = F.coalesce("context", F.lit(""))
        return out.select("query_id", context.alias("context"), F.coalesce("krefs", F.array().cast("array<string>")).alias("krefs"), F.coalesce(F.size("krefs"), F.lit(0)).alias("results"), approx_tokens(context).alias("tokens"))

    def reflect(self, captures: DataFrame, spaces: DataFrame, default: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Captures as revisions, what was dropped of them and why, and whether the batch stacks."""
        return runs.reflected(captures, spaces, default)

    def consolidate(self, least: int = 1) -> DataFrame:
        """One screened revision of each session, by the summariser where there is one."""
        return runs.consolidated(self.messages, None if self.summarise is None else summarised(self.messages, self.summarise), least)

    def decompose(self, rows: DataFrame, conv: str) -> tuple[DataFrame, DataFrame]:
        """The typed nodes of extractions, and the edges from statements to the entities that they name."""
        nodes = ontology.typed_nodes(rows, conv)
        return nodes, ontology.mention_edges(nodes)

    def capture(self, found: DataFrame, unit: str, markers: DataFrame, failed: DataFrame | None = None) -> runs.Capture:
        """What decisions found in commits or sessions write."""
        return runs.capture(found, unit, markers, failed)

    def answer(self, message: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The buffer with the assistant's answers, and the assessments that are due."""
        return state.answered(self.messages, message, self.config)

    def clear(self, sessions_: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The buffer without sessions, and how many messages each had."""
        return state.cleared(self.messages, sessions_)

    def dream(self, rows: DataFrame, assess: Assessor, ident: str, text: str, batch: str) -> DataFrame:
        """Rows assessed by batch, with those to park told apart."""
        return runs.assessed(rows, assess, ident, text, batch)

    def maintain(self, passes: Sequence[runs.Pass]) -> tuple[dict[str, DataFrame], DataFrame]:
        """The tables after maintenance passes, and its report."""
        tables = {k: getattr(self, k) for k in ("revisions", "edges", "messages") if getattr(self, k) is not None}
        return runs.run_passes(self.spark, tables, passes)

    def embeddings(self, text: str = "summary") -> DataFrame:
        """The revisions with vectors of the embedder."""
        if self.embed is None:
            raise ValueError("no embedder was given")
        return embedded(self.revisions, text, self.embed)

    def expand(self, seeds: DataFrame) -> DataFrame:
        """One hop from seeds (node, seed_rank)."""
        return graph.expand(seeds, self._edges(), self.config.walked)

    def contested(self, rows: DataFrame, ident: str) -> DataFrame:
        disputes = self.edges.where("edge_type = 'CONTRADICTS'").select(F.col("source_kref").alias("disputing"), F.col("target_kref").alias("disputed"), "basis")
        return graph.contested(rows, disputes, ident, self.config)

    def context(self, rows: DataFrame, key: str, part: str, score: str, ident: str) -> DataFrame:
        return context.composed(rows, key, part, score, ident, self.config)

    def profile(self, rows: DataFrame) -> DataFrame:
        """Signals, scores and label of each space."""
        return profiling.scores(profiling.signals(rows, self.config), self.config)

    def last_messages(self, limit: int = 10, offset: int = 0) -> DataFrame:
        return sess.last_messages(self.messages, limit, offset)

    def duplicates(self, rows: DataFrame, ident: str, text: str, within: Sequence[str]) -> DataFrame:
        return maintenance.duplicate_candidates(rows, ident, text, self.config.fact_duplicate, within)

    def views(self) -> None:
        """The tables as temporary views, for Spark SQL."""
        for name in ("revisions", "edges", "messages"):
            if getattr(self, name) is not None:
                getattr(self, name).createOrReplaceTempView(name)

    def _edges(self) -> DataFrame:
        return self.edges.select(F.col("source_kref").alias("source"), F.col("target_kref").alias("target"), "edge_type")
