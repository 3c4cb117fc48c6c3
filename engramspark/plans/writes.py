"""Queries of writes, ledgers, decision legs and small labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as Q
from ..functions.text import edge_name
from ..operators import decisions as D
from ..operators import writes as W
from ..schemas import KIND_PRIORITY, RELATIONS, WALKED_EDGES
from ..sources import graph as A
from ..sources import memory as M
from ..sources.memory import with_views
from .registry import jaccard_sql, query, tokens_sql
from .upkeep import _GUARD, _guarded


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' OR event_id % 7 = 3 THEN 'error' ELSE 'action' END AS type, event_type || ' ' || props || CASE WHEN (event_type = 'error' OR event_id % 7 = 3) THEN chr(10) || 'trace' ELSE '' END || chr(10) || props AS summary FROM events"""
)
def tool_execution_memory(spark: SparkSession, d: str) -> DataFrame:
    e = M.table(spark, d, "events")
    rows = e.select("event_id", F.concat_ws(" ", "event_type", "props").alias("task"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.when(F.col("event_id") % 7 == 3, 1).otherwise(0).alias("exit_code"), F.col("props").alias("stdout"), F.lit("trace").alias("stderr"))
    return W.tool_executions(rows, "event_id").select("event_id", "type", "summary")


@query(
    """WITH h AS (SELECT o_custkey AS source, o_orderkey % 200 AS kref, max((o_orderkey * 7919 % 1000) / 1000.0E0) AS score FROM orders WHERE o_custkey <> o_orderkey % 200 GROUP BY 1, 2)
SELECT source, kref AS target, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, kref) AS k FROM h WHERE score >= 0.3E0) WHERE k <= 3"""
)
def discover_edges(spark: SparkSession, d: str) -> DataFrame:
    hits = M.table(spark, d, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 200).alias("kref"), (F.col("o_orderkey") * 7919 % 1000 / 1000.0).alias("score"))
    return W.discovered_edges(hits, "source").select("source", "target", "score")


@query(
    """WITH f AS (SELECT user_id AS key, count(*) AS n, count(*) FILTER (value > 50) AS d FROM events WHERE event_type = 'error' GROUP BY user_id), l AS (SELECT DISTINCT user_id AS key, 1 AS a FROM events WHERE user_id % 2 = 0)
SELECT coalesce(f.key, l.key) AS key, (coalesce(a, 0) + coalesce(n, 0))::INT AS attempts, coalesce(a, 0) + coalesce(d, 0) >= 2 AS parked FROM l FULL JOIN f ON f.key = l.key"""
)
def ledger_record(spark: SparkSession, d: str) -> DataFrame:
    e = M.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    none = F.lit(None)
    ledger = e.where("user_id % 2 = 0").select(F.col("user_id").alias("key")).distinct().select("key", F.lit(1).alias("attempts"), F.lit(1).alias("deterministic_attempts"), none.cast("timestamp").alias("first_seen"), none.cast("timestamp").alias("last_seen"), none.cast("string").alias("last_error_class"), none.cast("timestamp").alias("parked_at"))
    failures = e.where("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), (F.col("value") > 50).alias("deterministic"), F.lit("E").alias("error_class"))
    return W.recorded(ledger, failures).select("key", "attempts", F.col("parked_at").isNotNull().alias("parked"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'succeeded' WHEN event_id % 5 = 1 OR event_id % 3 = 2 THEN 'dropped' ELSE 'failed' END AS fate FROM events"""
)
def queue_flush(spark: SparkSession, d: str) -> DataFrame:
    e = M.table(spark, d, "events")
    queue = e.select(F.col("event_id").alias("key"), (F.col("event_id") % 3).cast("int").alias("attempts"))
    results = e.select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 5 == 1, "deterministic").when(F.col("event_id") % 5 != 0, "transient").alias("error_class"))
    return W.flushed(queue, results).select(F.col("key").alias("event_id"), "fate")


@query("SELECT event_id, CASE WHEN value::INT % 600 IN (408, 425, 429) OR value::INT % 600 BETWEEN 500 AND 599 THEN 'transient' WHEN value::INT % 600 BETWEEN 400 AND 499 THEN 'deterministic' WHEN event_type = 'error' THEN 'transient' ELSE 'unknown' END AS class FROM events")
def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    status = F.rint("value").cast("int") % 600  # halves go to the even number, as in a cast of SQL
    e = M.table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "Connection reset").alias("m"), status.alias("s"))
    return e.select("event_id", W.failure_class(F.col("s"), F.col("m")).alias("class"))


@query(
    f"""WITH n AS (SELECT doc_id, source, {tokens_sql("text")} AS w FROM documents), p AS (SELECT a.doc_id AS newer, b.doc_id AS older, {jaccard_sql("a.w", "b.w")} AS s, {jaccard_sql("['la', 'des', 'une']", "b.w")} AS h FROM n a JOIN n b ON a.source = b.source AND a.doc_id <> b.doc_id AND b.doc_id % 100 < a.doc_id % 100)
SELECT DISTINCT newer, older, round(s, 6) AS score FROM p WHERE s >= CASE WHEN h >= 0.2E0 THEN 0.35E0 ELSE 0.5E0 END"""
)
def supersede_pass(spark: SparkSession, d: str) -> DataFrame:
    docs = M.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array("source").alias("anchors"), (F.col("doc_id") % 100).alias("decided_at"), "text", F.lit("une la des").alias("hint"))
    return D.supersede_candidates(docs, docs).select("newer", "older", F.round("score", 6).alias("score"))


@query(
    """SELECT l_partkey AS decision, l_suppkey AS anchor, bool_or(coalesce(40 BETWEEN l_linenumber * 10 - 20 AND l_linenumber * 10 + 25, false)) AS line_hit FROM lineitem GROUP BY 1, 2"""
)
def code_anchor_leg(spark: SparkSession, d: str) -> DataFrame:
    li = M.table(spark, d, "lineitem")
    edges = li.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.lit("IMPLEMENTED_IN").alias("edge_type"), (F.col("l_linenumber") * 10).cast("string").alias("line_start"), (F.col("l_linenumber") * 10 + 5).cast("string").alias("line_end"), F.lit("c").alias("commit_hash"))
    anchors = li.select(F.col("l_suppkey").alias("anchor"), F.lit(40).alias("line")).distinct()
    return D.anchored(anchors, edges).select("decision", "anchor", "line_hit")


@query("SELECT l_partkey AS decision, max((l_orderkey * 31 % 1000) / 1000.0E0) AS score FROM lineitem GROUP BY l_partkey")
def evidence_bridge_leg(spark: SparkSession, d: str) -> DataFrame:
    li = M.table(spark, d, "lineitem")
    edges = li.select(F.col("l_partkey").alias("source"), F.col("l_orderkey").alias("target"), F.lit("MOTIVATED_BY").alias("edge_type")).distinct()
    hits = li.select(F.col("l_orderkey").alias("evidence"), (F.col("l_orderkey") * 31 % 1000 / 1000.0).alias("score")).distinct()
    return D.evidence_bridge(hits, edges)


_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]+')"


@query(
    rf"""WITH n AS (SELECT conv_id, turn, text AS said, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations), q AS (SELECT conv_id, turn, source, CASE WHEN turn % 3 = 0 THEN upper(substr(source, 5, 30)) ELSE substr(said, 1, 40) || ' ' || substr(source, 1, 60) END AS s FROM n WHERE source IS NOT NULL),
f AS (SELECT *, lower(trim(regexp_replace(s, '\s+', ' ', 'g'))) AS flat, lower(trim(regexp_replace(source, '\s+', ' ', 'g'))) AS whole, list_distinct({_WORDS.format("s")}) AS w, list_distinct({_WORDS.format("source")}) AS v FROM q)
SELECT conv_id, turn, contains(whole, flat) OR CASE WHEN len(w) > 0 THEN len(list_intersect(w, v)) * 1.0E0 / len(w) ELSE 0E0 END >= 0.6E0 AS verbatim FROM f"""
)
def verbatim_check(spark: SparkSession, d: str) -> DataFrame:
    """Statements against the next message: a piece of it in capitals, or the beginnings of both."""
    from pyspark.sql import Window

    c = M.table(spark, d, "conversations").withColumn("source", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("source is not null")
    said = F.when(F.col("turn") % 3 == 0, F.upper(F.substring("source", 5, 30))).otherwise(F.concat(F.substring("text", 1, 40), F.lit(" "), F.substring("source", 1, 60)))
    return c.select("conv_id", "turn", D.verbatim(said, F.col("source")).alias("verbatim"))


@query("SELECT user_id, 'P/' || CASE user_id % 4 WHEN 0 THEN 'work/t' || user_id WHEN 1 THEN 'groups/default' ELSE 'personal' END AS space, count(*) AS n FROM events GROUP BY user_id")
def channel_spaces(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("user_id") % 4
    channel = F.when(m == 0, "team_channel").when(m == 1, "group_dm").otherwise("irc")
    space = Q.channel_space(channel, F.lit("P"), F.concat(F.lit("t"), F.col("user_id").cast("string")), F.lit(""))
    return M.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", space.alias("space"), "n")


@query(r"SELECT DISTINCT p_type AS predicate, upper(trim(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS edge_type FROM part")
def predicate_edge_types(spark: SparkSession, d: str) -> DataFrame:
    return M.table(spark, d, "part").select(F.col("p_type").alias("predicate"), edge_name(F.col("p_type")).alias("edge_type")).distinct()


@query("SELECT o_orderkey, sha256(o_orderpriority) AS sha256, substr(sha256(o_orderpriority), 1, 12) || '-' || o_orderkey AS file FROM orders")
def artifact_names(spark: SparkSession, d: str) -> DataFrame:
    rows = M.table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("name"), "o_orderpriority")
    return W.artifacts(rows, "name", "o_orderpriority").select(F.col("name").cast("long").alias("o_orderkey"), "sha256", "file")


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS order_key, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1")
def first_source_rows(spark: SparkSession, d: str) -> DataFrame:
    """Explicit rows first, then the buffer's, then the archive's: each session once from the first that has it."""
    o = M.table(spark, d, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("session_id"))
    rows = A.first_source(o.where("session_id % 2 = 0"), o.where("session_id % 3 = 0"), o)
    return rows.groupBy(F.col("session_id").alias("order_key")).agg(F.count("*").alias("n"))


def _rows_sql(rows: list[tuple[str, ...]], names: str) -> str:
    """Constant rows as SQL."""
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) v({names})"


@query(_rows_sql([*(("kind", k, str(i)) for i, k in enumerate((*KIND_PRIORITY, "entity", "action", "question"))), *(("edge", e, str(i)) for i, e in enumerate(WALKED_EDGES)), *(("relation", r, ",".join(sorted(x))) for r, x in RELATIONS.items())], "part, name, detail"))
def ontology_spec(spark: SparkSession, d: str) -> DataFrame:
    return W.ontology_spec(spark)


@query(with_views("v_revisions", body=f"{_GUARD}, o AS (SELECT coalesce(refused, 'applied') AS outcome, count(*) AS n FROM g GROUP BY 1) SELECT sum(n)::BIGINT AS proposals, '# Run report' || chr(10) || chr(10) || string_agg('- ' || outcome || ': ' || n, chr(10) ORDER BY outcome) AS markdown FROM o"))
def run_report(spark: SparkSession, d: str) -> DataFrame:
    return W.run_report(_guarded(spark, d))


@query(
    r"""WITH e AS (SELECT DISTINCT regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') AS slug, lower(split_part(p_name, ' ', 1)) AS name FROM part), s AS (SELECT DISTINCT p_partkey AS id, trim(regexp_replace(lower(p_brand), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug FROM part WHERE p_brand IS NOT NULL)
SELECT id, slug, 'ABOUT' AS edge_type FROM (SELECT id, slug FROM s WHERE slug IN (SELECT slug FROM e) UNION SELECT p_partkey, slug FROM part JOIN e ON name <> '' AND list_contains(regexp_extract_all(lower(p_name), '[\p{L}\p{N}\p{M}\p{Pc}]+'), name))"""
)
def symbol_bridges(spark: SparkSession, d: str) -> DataFrame:
    p = M.table(spark, d, "part")
    decisions = p.select(F.col("p_partkey").alias("id"), F.array("p_brand").alias("symbols"), F.col("p_name").alias("text"))
    entities = p.select(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "-").alias("slug"), F.substring_index("p_name", " ", 1).alias("name")).distinct()
    return D.symbol_bridges(decisions, entities)
