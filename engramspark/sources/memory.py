"""Memory views over star-schema tables, and their SQL.

The same expressions build each view as a DataFrame and as SQL, so that any engine sees the same graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("idx"), "role", F.col("text").alias("content"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    level = (
        F.when(F.col("doc_id") % 50 == 0, "official")
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), "corroborated")
        .when(F.col("quality") == 1, "single_source")
        .when(F.col("quality") == 0, "unverified")
    )
    return d.join(lab, "doc_id", "left").select(
        "doc_id",
        F.col("source").alias("space"),
        F.floor(F.col("doc_id") / 4).cast("long").alias("item_id"),
        (F.col("doc_id") % 4 + 1).cast("long").alias("number"),
        F.substring("text", 1, 60).alias("title"),
        "text",
        level.alias("evidence_level"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("published"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("deprecated"),
        ((F.col("doc_id") * 7919) % 1000 / 1000.0).alias("base_score"),
        (F.col("doc_id") % 365).cast("long").alias("age_days"),
    )


def about(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ABOUT parts and customers; entities are numbered apart (parts even, customers odd)."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parts = li.select(F.col("l_orderkey").alias("memory_id"), (F.col("l_partkey") * 2).alias("entity_id"), F.lit("ABOUT").alias("edge_type"))
    customers = o.select(F.col("o_orderkey").alias("memory_id"), (F.col("o_custkey") * 2 + 1).alias("entity_id"), F.lit("ABOUT").alias("edge_type"))
    return parts.unionByName(customers).distinct()


def supersedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order supersedes its customer's order before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("newer_id"), F.lag("o_orderkey").over(w).alias("older_id"))
    return o.where("older_id is not null")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("key"), "event_type", "value", "props")


VIEWS = {
    "v_messages": "SELECT conv_id AS session_id, CAST(turn AS BIGINT) AS idx, role, text AS content FROM conversations",
    "v_revisions": """SELECT d.doc_id, d.source AS space, d.doc_id // 4 AS item_id, d.doc_id % 4 + 1 AS number, substr(d.text, 1, 60) AS title, d.text,
      CASE WHEN d.doc_id % 50 = 0 THEN 'official' WHEN l.quality = 1 AND l.toxic = 0 THEN 'corroborated' WHEN l.quality = 1 THEN 'single_source'
           WHEN l.quality = 0 THEN 'unverified' END AS evidence_level,
      coalesce(l.quality = 1, false) AS published, coalesce(l.toxic = 1, false) AS deprecated,
      ((d.doc_id * 7919) % 1000) / 1000.0E0 AS base_score, d.doc_id % 365 AS age_days
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "v_about": """SELECT DISTINCT * FROM (SELECT l_orderkey AS memory_id, l_partkey * 2 AS entity_id, 'ABOUT' AS edge_type FROM lineitem
      UNION ALL SELECT o_orderkey, o_custkey * 2 + 1, 'ABOUT' FROM orders)""",
    "v_supersedes": """SELECT newer_id, older_id FROM (SELECT o_orderkey AS newer_id,
      lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS older_id FROM orders) WHERE older_id IS NOT NULL""",
    "v_log": "SELECT event_id, ts, user_id AS key, event_type, value, props FROM events",
}


def with_views(*names: str, body: str) -> str:
    """SQL with the views named; ``body`` is a SELECT, or further common tables and a SELECT."""
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {head}{'' if body.lstrip().upper().startswith('SELECT') else ','}\n{body}"
