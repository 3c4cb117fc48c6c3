"""Queries of sessions, ledgers, transcripts and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sessions as S
from ..sources import memory as M
from ..sources.memory import with_views
from ..streaming import sessions as K
from .registry import query


@query(
    with_views(
        "v_messages",
        body="SELECT session_id, idx, role, message_count FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) AS k, count(*) OVER (PARTITION BY session_id) AS message_count FROM v_messages) WHERE k BETWEEN 2 AND 4",
    )
)
def last_n_messages(spark: SparkSession, d: str) -> DataFrame:
    return S.last_messages(M.messages(spark, d), 3, 1).select("session_id", "idx", "role", "message_count")


@query(with_views("v_messages", body="SELECT session_id, count(*) AS messages, min(idx) AS first_idx, max(idx) AS last_idx, count(*) >= 50 AS should_consolidate FROM v_messages GROUP BY session_id"))
def session_list(spark: SparkSession, d: str) -> DataFrame:
    by = M.messages(spark, d).groupBy("session_id").agg(F.count("*").alias("messages"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    return by.withColumn("should_consolidate", F.col("messages") >= 50)


@query(
    with_views(
        "v_messages",
        body=rf"""t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) AS k FROM v_messages),
o AS (SELECT session_id, string_agg(content, ' ' ORDER BY idx) AS a, max_by(content, idx) AS last FROM t WHERE k <= 4 AND coalesce(content, '') <> '' GROUP BY session_id)
SELECT session_id, length(trim(a)) >= 60 AND NOT regexp_matches(trim(last), '{S.SKIP.replace("'", "''").replace(".{0,2000}", ".{0,1000}.{0,1000}")}') AND regexp_matches(a, '{S.STORE.replace("'", "''")}') AS candidate FROM o""",
    )
)
def prefilter_candidates(spark: SparkSession, d: str) -> DataFrame:
    return S.worth_storing(M.messages(spark, d))


_LINES = "string_split(content, chr(10))"
_FULL = f"list_filter({_LINES}, lambda x: trim(x) <> '')"
_BASE = rf"""(CASE WHEN regexp_matches(content, '{S.DECIDE.replace("'", "''")}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(content, '(?i)considered\b.{{0,80}}\bbut\b|why not\b|\S+ 말고|\S+ 대신') THEN 3 ELSE 0 END
  + CASE WHEN regexp_matches(content, '(?i)benchmark|measured|실측|p9\d|\brecall\b|\bF1\b|\d+(?:[.]\d+)?\s*(?:tokens?\b|MB\b|ms\b|s\b|x\b|%|점)') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(content, '(?i)blocker|confirmed|critical|defect|지적|리뷰') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(content, '\b[0-9a-f]{{7,40}}\b') THEN 2 ELSE 0 END
  + least(3, CASE WHEN regexp_matches(content, '\b[0-9A-Za-z_./\\-]+[.](?:cpp|c|go|h|java|json|js|md|py|rs|toml|tsx|ts|yaml|yml)\b') THEN 1 ELSE 0 END + least(2, len(regexp_extract_all(content, '`[^`\s][^`]*`'))))
  - CASE WHEN regexp_matches(content, '[A-Za-z0-9+/=]{{120,}}') THEN 2 ELSE 0 END
  - CASE WHEN len({_LINES}) >= 5 AND len(list_filter({_FULL}, lambda x: length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) * 1.0E0 / greatest(1, length(x)) < 0.2E0)) * 1.0E0 / len({_LINES}) > 0.8E0 THEN 2 ELSE 0 END
  - CASE WHEN length(content) > 500 AND len({_LINES}) > 9 AND NOT regexp_matches(content, '{S.DECIDE.replace("'", "''")}') AND len({_FULL}) > 0 AND len(list_filter({_FULL}, lambda x: regexp_matches(x, '^(?:[ \t{{}}]|class |def |import )'))) * 1.0E0 / greatest(1, len({_FULL})) > 0.7E0 THEN 2 ELSE 0 END)::BIGINT"""


@query(with_views("v_messages", body=f"SELECT session_id, idx, {_BASE} AS score FROM v_messages"))
def salience_base(spark: SparkSession, d: str) -> DataFrame:
    return M.messages(spark, d).select("session_id", "idx", S.base_salience(F.col("content")).alias("score"))


@query(
    "WITH RECURSIVE "
    + with_views("v_messages", body="SELECT 1").removesuffix("\nSELECT 1").removeprefix("WITH ")
    + f""",
b AS (SELECT session_id, idx, {_BASE} AS base, role = 'user' AND length(content) <= 80 AND regexp_matches(content, '{S.ASSENT}') AS assents, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS n FROM v_messages),
r AS (SELECT session_id, n, idx, base AS score FROM b WHERE n = 1 UNION ALL SELECT b.session_id, b.n, b.idx, b.base + CASE WHEN assents AND r.score >= 4 THEN 1 ELSE 0 END FROM r JOIN b ON b.session_id = r.session_id AND b.n = r.n + 1)
SELECT session_id, idx, score FROM r"""
)
def salience_scored(spark: SparkSession, d: str) -> DataFrame:
    return S.salience(M.messages(spark, d)).select("session_id", "idx", "score")


@query(
    """WITH m AS (SELECT conv_id AS session_id, turn AS idx, CASE WHEN (conv_id * 7 + turn * 3) % 5 = 0 THEN 2 ELSE 0 END AS score FROM conversations),
w AS (SELECT *, max((score >= 2)::INT) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS keep, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS pos, count(*) OVER (PARTITION BY session_id) AS n FROM m)
SELECT session_id, idx, pos - lag(pos, 1, 0) OVER (PARTITION BY session_id ORDER BY idx) - 1 AS elided FROM w WHERE keep = 1 OR pos <= 2 OR pos > n - 3"""
)
def select_with_neighbours(spark: SparkSession, d: str) -> DataFrame:
    c = M.table(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), F.when((F.col("conv_id") * 7 + F.col("turn") * 3) % 5 == 0, 2).otherwise(0).alias("score"))
    return S.selected(rows).select("session_id", "idx", "elided")


@query()
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(S.selected(S.salience(M.messages(spark, d))))


@query(
    with_views(
        "v_messages",
        body="""SELECT session_id, '# Conversation ' || session_id || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg('### ' || upper(left(role, 1)) || substr(role, 2) || chr(10) || chr(10) || content || chr(10), chr(10) ORDER BY idx) AS markdown FROM v_messages GROUP BY session_id""",
    )
)
def conversation_markdown(spark: SparkSession, d: str) -> DataFrame:
    return S.markdown(M.messages(spark, d))


@query(with_views("v_messages", body="SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS idx, role, NULL::VARCHAR AS ts, trim(content) AS content FROM v_messages"))
def markdown_round_trip(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.transcripts import parse_markdown

    return parse_markdown(S.markdown(M.messages(spark, d)))


@query("SELECT event_id, user_id, strftime(ts, '%Y%m%d') AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS sequence FROM events")
def session_sequence(spark: SparkSession, d: str) -> DataFrame:
    e = M.table(spark, d, "events")
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return e.select("event_id", "user_id", F.date_format("ts", "yyyyMMdd").alias("day"), F.row_number().over(w).cast("long").alias("sequence"))


@query(
    """WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 3600 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events FROM s GROUP BY user_id, n"""
)
def session_gap_windows(spark: SparkSession, d: str) -> DataFrame:
    return K.sessions(M.log(spark, d), "key").select(F.col("key").alias("user_id"), F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "events")


@query("SELECT event_id, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) <= 86400, false) AS repeats FROM events")
def recall_dedup_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("key", "event_type").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (at - F.lag(at).over(w)) / 1e6
    return M.log(spark, d).select("event_id", F.coalesce(gap <= 86400, F.lit(False)).alias("repeats"))


@query(
    """WITH f AS (SELECT user_id AS key, event_id, ts, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, failed, n, coalesce(max(CASE WHEN NOT failed THEN n END) OVER (PARTITION BY key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reset FROM f),
c AS (SELECT key, n, count(*) FILTER (failed) OVER (PARTITION BY key, reset ORDER BY n ROWS UNBOUNDED PRECEDING) AS streak, failed FROM r)
SELECT key, count(*) FILTER (failed AND streak = 2) AS parked_times, count(*) FILTER (failed) AS attempts FROM c GROUP BY key"""
)
def failure_parking(spark: SparkSession, d: str) -> DataFrame:
    return K.ledger(M.log(spark, d))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' OR event_id % 500 = 0")
def incremental_since_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Rows after the cursor; those whose time can't be read are included."""
    e = M.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 500 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise("unknown").alias("created"))
    return K.since(e, "created", "2024-01-20 00:00:00").select("event_id")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'merge' WHEN o_orderkey % 10 = 1 THEN 'generated_files' WHEN o_orderkey % 10 = 2 THEN 'version_bump' WHEN o_orderkey % 10 = 3 THEN 'trivial' END AS rejected FROM orders"""
)
def commit_prefilter(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("o_orderkey") % 10
    subject = F.when(m == 2, "bump the engine to a new version").when(m == 3, "fix it").otherwise("rework the order of joins for speed")
    files = F.when(m == 1, F.array(F.lit("web/yarn.lock"), F.lit("dist/app.js"))).when(m == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("src/main.py"), F.lit("yarn.lock")))
    parents = F.when(m == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return M.table(spark, d, "orders").select("o_orderkey", S.commit_filter(parents, subject, F.lit(""), files).alias("rejected"))


@query()
def event_date_confidence(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.temporal import confidence

    rows = M.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderdate").alias("ts"))
    m = F.col("o_orderkey") % 4
    text = F.when(m == 0, F.concat(F.lit("It was settled on "), F.col("day"))).when(m == 1, F.lit("We agreed yesterday.")).when(m == 2, F.lit("Sometime, perhaps.")).otherwise(F.concat(F.lit("Back in "), F.date_format("ts", "MMMM yyyy")))
    event = F.when(m == 1, F.date_format(F.date_sub("ts", 1), "yyyy-MM-dd")).otherwise(F.col("day"))
    return rows.select("o_orderkey", confidence(event, text, F.date_format("ts", "yyyy-MM-dd")).alias("confidence"))
