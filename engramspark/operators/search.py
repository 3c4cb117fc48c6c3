"""Hybrid search: BM25 with frequencies per project and kind, mixed with cosine where there are vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_tokens
from ..sources.store import written
from .ranking import top_k


def postings(docs: DataFrame, ident: str, text: str, within: Sequence[str] = ()) -> DataFrame:
    """token, ident, tf and length of every token of every document; one scan, aggregated inside each document before anything is shuffled."""
    words = docs.select(*within, F.col(ident).alias("id"), key_tokens(F.col(text)).alias("w"))
    distinct = words.select(*within, "id", F.size("w").alias("length"), F.explode(F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("token"), F.size(F.filter("w", lambda x: x == t)).alias("tf")))).alias("p"))
    return distinct.select(*within, "id", "length", "p.token", "p.tf")


def bm25(docs: DataFrame, queries: DataFrame, ident: str, text: str, within: Sequence[str] = (), k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id and score of every document that shares a token with a query (query_id, query), by frequencies inside its group.

    Only the queries' tokens are looked up: their list is a bounded set, checked, and broadcast, so the documents' other
    tokens are dropped where they are read.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(key_tokens(F.col("query")))).alias("token"))
    if q.count() > 100_000:
        raise ValueError("too many query tokens for one block; search per block")
    wanted = q.select("token").distinct()
    words = docs.select(*within, F.col(ident).alias("id"), key_tokens(F.col(text)).alias("w"))
    asked = [r.token for r in wanted.limit(1001).collect()]
    if len(asked) <= 1000:  # they fit into the expression, and nothing else of a document is kept
        words = words.select(*within, "id", F.size("w").alias("length"), F.filter("w", lambda x: x.isin(*asked)).alias("w"))
    else:
        words = words.select(*within, "id", F.size("w").alias("length"), "w")
    words = written(words, "words")  # texts are cut into words once
    group = (words.groupBy(*within) if within else words.groupBy()).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = words.select(*within, "id", "length", F.explode("w").alias("token")).join(F.broadcast(wanted), "token").groupBy(*within, "id", "length", "token").agg(F.count("*").alias("tf"))
    df = hits.groupBy(*within, "token").agg(F.count("*").alias("df"))
    on = [*within]
    scored = hits.join(df, [*within, "token"])
    scored = scored.join(group, on) if on else scored.join(F.broadcast(group))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return scored.withColumn("part", part).join(F.broadcast(q), "token").groupBy("query_id", *within, "id").agg(F.sum("part").alias("score"))


def hybrid(lexical: DataFrame, vector: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """The best ``k`` of each query by the mix of scaled BM25 and cosine; ``score_method`` says which of them a row had."""
    from pyspark.sql import Window

    top = F.max("score").over(Window.partitionBy("query_id"))
    lex = lexical.select("query_id", "id", F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0)).alias("lex"))
    both = lex.join(vector.select("query_id", "id", F.col("score").alias("vec")), ["query_id", "id"], "full")
    score = weight * F.coalesce("lex", F.lit(0.0)) + (1 - weight) * F.coalesce("vec", F.lit(0.0))
    method = F.when(F.col("vec").isNull(), "fulltext").when(F.col("lex").isNull(), "vector").otherwise("hybrid")
    return top_k(both.withColumns({"score": score, "score_method": method}), ["query_id"], [F.col("score").desc(), F.col("id")], k)
